import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rivulet.llm import prefix_trie as P
from tests.llm.helpers import CLASHING

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            dig = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, dig, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in convs.items()}
    if rebuild:
        built = {}
        for c, ts in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
            built[c] = own.get(base, [])[:h] + ts[h:]
        own = built
    nodes = {}
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids, below = {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        saved = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            s = below.setdefault(p[:d], [0, 0])
            s[0] += p not in kids
            s[1] += saved
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), below[p][0], below[p][1],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(own[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items()]


def messy_conversations(seed=1, n=60):
    rnd = random.Random(seed)
    lines = ["hi", "hello", "ça va?", "", None, "x" * 3000, "\U0001f600"]
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 2, 3, 5, 6, 9, 13])):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if t > 3 else "user", rnd.choice(lines[:2] if t < 3 else lines)))
    first = [r for r in rows if r[0] == 10]
    for c in range(100, 125):  # copies
        rows += [(c, *r[1:]) for r in first]
    rows += [(200, t, None, "same") for t in range(300)] + [(201, t, None, "same") for t in range(299)] + [(200 + 15, t, "", "same") for t in range(150)]
    rows += [(7, None, "system", "null turn"), (7, None, None, None), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (8, 0, "user", "another"),
             (None, 0, "user", "no id"), (None, None, None, None), (-7, 0, "user", "hi"), (-7, 1, "user", "hello"), (-5, 0, "user", "hi"),
             (3000003, 0, "user", "its base is absent"), (9, None, "user", "z")]
    return rows


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns(
        {c: F.lit("clash") for c in (*CLASHING, "c", "pos", "dig", "bytes", "name", "above", "_range", "_at")})
    return sorted((tuple(r) for r in P.conversation_trie(df, **options).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def test_against_brute_force(spark):
    rows = messy_conversations()
    assert got(spark, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("block,rebuild", [(1, False), (3, True), (16, False)])
def test_blocks_of_other_lengths(spark, block, rebuild):
    rows = messy_conversations(seed=block)
    assert got(spark, rows, block=block, rebuild=rebuild) == sorted(brute(rows, rebuild), key=repr)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(5, 1, "a", "b")], [(1, 0, None, None)] * 3, [(c, None, None, None) for c in range(20)]])
def test_small_tables(spark, rows):
    assert got(spark, rows) == sorted(brute(rows), key=repr)


def test_sql_over_messy_rows(spark):
    rows = messy_conversations(seed=9, n=25)
    con = duckdb.connect()
    con.register("t", spark.createDataFrame(rows, SCHEMA).toArrow())
    con.execute("CREATE VIEW conversations AS SELECT * FROM t")
    want = con.execute("SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM (" + P.SQL + ")").fetchall()
    assert sorted(want, key=repr) == sorted(brute(rows), key=repr)


def test_running_sums_of_a_key_over_many_ranges(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, 2, 2, 2, 2, 2, 3, 4]), i, rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint").repartition(7)
    out = P.running_sums(df, "k", ["o"], ["v"])
    sums, want = {}, {}
    for k, o, v in sorted(rows):
        sums[k] = sums.get(k, 0) + v
        want[(k, o)] = sums[k]
    assert {(r.k, r.o): r.v for r in out.collect()} == want


def test_ids_of_one_node_are_joined_in_chunks(spark):
    n = 3 * P.CHUNK_IDS + 5
    ends = spark.range(n).select(F.when(F.col("id") % 10 == 3, "b").otherwise("a").alias("key"), F.col("id").alias("c")).repartition(9)
    want = {k: hashlib.sha256(",".join(str(i) for i in range(n) if (i % 10 == 3) == (k == "b")).encode()).hexdigest() for k in "ab"}
    assert {r.key: r.sha for r in P.ends_digests(ends).collect()} == want
