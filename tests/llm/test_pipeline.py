import corpus_pipeline as C
from rivulet.llm import exact_dedup, mixing, packing, quality, simhash
from tests.conftest import SF_SMALL
from tests.llm.helpers import messy, messy_rows


def test_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    def write(df, n):
        from rivulet.session import materialize
        return materialize(df, f"test-{n}")

    one = write(C.quality_stage(spark, docs, SF_SMALL), 1)
    assert ids(one) == ids(quality.quality(docs, labels).where("predicted = 1"))
    two = write(C.exact_stage(spark, one, SF_SMALL), 2)
    assert ids(two) == ids(exact_dedup.exact_dedup(one).where("kept"))
    three = write(C.near_stage(spark, two, SF_SMALL), 3)
    assert ids(three) == ids(simhash.near_duplicates(two).where("doc_id = component_id"))
    four = write(C.mixing_stage(spark, three, SF_SMALL), 4)
    assert ids(four) == sorted(r.doc_id for r in mixing.mix(three).collect() for _ in range(r.times))
    five = C.packing_stage(spark, four, SF_SMALL)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(five) == key(packing.pack(four))
    assert key(C.run(spark, SF_SMALL)) == key(five)
    for df in (one, two, three, four):
        assert df.columns == docs.columns


def test_odd_rows_pass_every_stage(spark):
    docs = messy(spark, messy_rows())
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        out.count()
    assert C.STAGES[-1][1](spark, docs, SF_SMALL).count() >= docs.count()


def test_repeated_and_null_ids_lose_their_copies_in_both_stages(spark):
    rows = [(1, "one two three four", "en", "a"), (1, "one two three four", "en", "a"), (None, "one two three four", "en", "a"),
            (None, "five six seven eight", "en", "a"), (None, "five six seven eight", "en", "a")]
    docs = messy(spark, rows)
    for stage in (C.exact_stage, C.near_stage):
        assert sorted((r.doc_id or 0, r.text) for r in stage(spark, docs, SF_SMALL).collect()) \
            == [(0, "five six seven eight"), (1, "one two three four")]


def test_empty_table(spark):
    from tests.llm.helpers import empty
    docs = empty(spark)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF_SMALL).count() == 0
