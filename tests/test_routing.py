"""Switch and merge against the reference's switch fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators.routing import label_cases, merge, switch, switch_merge, tee, unmatched

VALUES = [1] * 5 + [0] * 4


@pytest.fixture()
def ones_zeros(spark):
    vals = VALUES[:]
    random.Random(7).shuffle(vals)
    return spark.createDataFrame([(v,) for v in vals], "value bigint")


def test_even_odd(ones_zeros):
    b = switch(ones_zeros, {"even": "value % 2 = 0", "odd": "value % 2 = 1"})
    assert b["even"].count() == 4 and b["odd"].count() == 5


def test_first_match_wins(ones_zeros):
    b = switch(ones_zeros, {"first": F.lit(1), "second": F.lit(1)})
    assert b["first"].count() == 9 and b["second"].count() == 0


def test_truthy_case_values(ones_zeros):
    b = switch(ones_zeros, {"odd": "value % 2", "rest": 1})
    assert b["odd"].count() == 5 and b["rest"].count() == 4


def test_unmatched_dropped(ones_zeros):
    cases = {"never": F.lit(False), "odd": "value % 2 = 1"}
    b = switch(ones_zeros, cases)
    assert b["never"].count() == 0 and b["odd"].count() == 5
    assert unmatched(ones_zeros, cases).count() == 4


def test_branch_invariant_and_merge(ones_zeros):
    cases = {"big": "value > 0", "zero": "value = 0"}
    b = switch(ones_zeros, cases)
    assert sum(x.count() for x in b.values()) + unmatched(ones_zeros, cases).count() == 9
    merged = merge(b["big"].withColumn("tag", F.lit("b")), b["zero"])
    assert merged.count() == 9 and merged.where("tag is null").count() == 4


def test_case_count_limits(ones_zeros):
    with pytest.raises(ValueError):
        label_cases(ones_zeros, {"only": 1})
    assert label_cases(ones_zeros, {str(i): 1 for i in range(21)}).count() == ones_zeros.count()


def test_merge_of_typed_ranges(spark):
    a = spark.range(3).toDF("id")
    b = spark.range(2).toDF("id").withColumn("x", F.lit(1))
    assert merge(a, b).count() == 5


def test_tee_every_sink_gets_all_rows(ones_zeros):
    assert tee(ones_zeros, [lambda d: d.count(), lambda d: d.where("value = 1").count()]) == [9, 5]


def test_switch_merge_equals_union_form(spark):
    from rivulet.operators.transform import alter
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 5, 9, 0, 3])], "i bigint, v bigint")
    cases = {"big": "v > 4", "small": "v > 0"}
    exprs = {"big": {"tag": "B", "v": "${{ v * 10 }}"}, "small": {"note": "${{ v + 1 }}"}}
    one = sorted(tuple(r) for r in switch_merge(df, cases, exprs).select("i", "v", "branch", "tag", "note").collect())
    b = switch(df, cases, keep_label=True)
    union = merge(alter(b["big"], exprs["big"]), alter(b["small"], exprs["small"]))
    two = sorted(tuple(r) for r in union.select("i", "v", "branch", "tag", "note").collect())
    assert one == two and len(one) == 4


def test_write_switch_one_job(spark, tmp, ones_zeros):
    from rivulet.operators.routing import write_switch
    write_switch(ones_zeros, {"one": "value = 1", "zero": "value = 0"}, f"{tmp}/br")
    got = {r["branch"]: r["n"] for r in spark.read.parquet(f"{tmp}/br").groupBy("branch").agg(F.count("*").alias("n")).collect()}
    assert got == {"one": 5, "zero": 4}


def test_branch_counts_sum_to_input(ones_zeros):
    from rivulet.operators.routing import branch_counts
    cases = {"never": F.lit(False), "odd": "value % 2 = 1"}
    got = {r["branch"]: r["n"] for r in branch_counts(ones_zeros, cases, include_unmatched=True).collect()}
    assert got == {"never": 0, "odd": 5, "(unmatched)": 4}


def test_switch_keeps_an_input_column_of_the_label_name(spark):
    df = spark.createDataFrame([(1, "mine"), (2, "mine")], "id bigint, branch string")
    parts = switch(df, {"odd": "id % 2 = 1", "even": 1})
    assert [tuple(r) for r in parts["even"].collect()] == [(2, "mine")]
    with pytest.raises(ValueError):
        switch_merge(df, {"odd": "id % 2 = 1", "even": 1})
    assert switch_merge(df, {"odd": "id % 2 = 1", "even": 1}, label_col="way").columns == ["id", "branch", "way"]


def test_any_number_of_branches(spark):
    df = spark.range(50)
    cases = {f"c{i}": f"id = {i}" for i in range(30)}
    assert merge(*switch(df, cases).values()).count() == 30
