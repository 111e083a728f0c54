import hashlib
import re

from pyspark.sql import functions as F

from rivulet.llm.exact_dedup import IDENTIFIERS, MAX_CHUNK, chunks, exact_dedup, without_copies
from tests.llm.helpers import empty, messy, messy_rows, with_null_ids


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = with_null_ids(messy_rows())
    out = exact_dedup(messy(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, out.collect()), key=repr) == expected(rows)


def test_identifiers_that_collide_are_not_used(spark):
    rows = messy_rows()
    weak = (lambda c: F.pmod(F.length(c), F.lit(3)), *IDENTIFIERS)
    only_text = (lambda c: F.lit(1), IDENTIFIERS[-1])
    for ids in (weak, only_text):
        out = exact_dedup(messy(spark, rows), identifiers=ids).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(tuple, out.collect()), key=repr) == expected(rows)


def test_chunks_are_the_text(spark):
    df = messy(spark).select("text", chunks(F.coalesce("text", F.lit(""))).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == norm(r.text)
        assert all(len(c) <= MAX_CHUNK for c in r.c)


def test_a_change_in_front_leaves_later_chunks_alone(spark):
    text = messy_rows()[75][1]
    a, b = (spark.createDataFrame([(t,)], "t string").select(chunks(F.col("t"))).first()[0] for t in (text, "moved by this " + text))
    assert len(a) > 50 and len(set(a) & set(b)) >= len(a) - 10


def test_rows_that_stay_keep_their_columns(spark):
    docs = messy(spark, with_null_ids(messy_rows()))
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    first = {}
    for i, t, *_ in with_null_ids(messy_rows()):
        words = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        first[words] = min(first.get(words, (True, 0)), (i is None, i or 0))
    want = sorted((None if none else i for none, i in first.values()), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "x y", "en", "a"), (1, "x  y", "en", "b"), (None, "x\ty", "en", "a"), (None, "z", "en", "a"), (None, "z", "en", "a"),
            (2, None, "en", "a"), (2, "", "en", "a"), (2, "other", "en", "a")]
    kept = without_copies(messy(spark, rows)).collect()
    assert sorted((r.doc_id, r.text or "") if r.doc_id else (0, r.text) for r in kept if r.text != "x y" and r.text != "x  y") \
        == [(0, "z"), (2, ""), (2, "other")]
    assert [r.doc_id for r in kept if r.text in ("x y", "x  y")] == [1]


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).count() == 0 and without_copies(empty(spark)).count() == 0
