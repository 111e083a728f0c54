import random
import re

import numpy as np
import pytest
import xxhash

from rivulet.llm import simhash as S
from tests.llm.helpers import empty, messy, messy_rows, with_null_ids


def brute_fingerprint(text, k=3):
    t = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def brute_components(fps, distance):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(spark):
    rows = with_null_ids(messy_rows())
    out = {}
    for r in S.near_duplicates(messy(spark, rows)).collect():
        out.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps, 3)
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None]
        assert (format(fps[k], "016x"), min(ids) if ids else None) in out[r[0]]
    assert sum(1 for _ in out) == len({r[0] for r in rows})


@pytest.mark.parametrize("distance,block", [(3, 4096), (3, 8), (0, 16), (5, 16)])
def test_links_connect_what_is_near(spark, distance, block):
    rnd = random.Random(distance)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(25):  # dense groups whose members differ from each other by more than the distance
            x = centre
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = S.links(df, distance, block)
    roots = {r.node: r.root for r in S.components(edges).collect()}
    want = brute_components(fps, distance)
    mine = [roots.get(x, x) for x in signed]
    pairs = lambda c: {frozenset(i for i in range(len(c)) if c[i] == v) for v in c}
    assert pairs(mine) == pairs(want)
    for e in edges.collect():
        assert bin((e.a ^ e.b) & ((1 << 64) - 1)).count("1") <= distance


def test_every_allocation_keeps_the_pigeonhole():
    rnd = np.random.default_rng(1)
    for n in (10, 10**4, 10**7, 10**11):
        for distance in (0, 1, 3, 5):
            d = [S.xor_distances(rnd.integers(0, 50, 1 << 16)) for _ in range(S.GROUPS)]
            parts = S.allocate(d, n, distance)
            assert sum(t + 1 for _, t in parts) == distance + 1
            groups = [g for p, _ in parts for g in p]
            assert len(groups) == len(set(groups))


def test_xor_distances_are_exact():
    counts = np.zeros(1 << 16)
    counts[[0, 1, 3, 65535]] = [2, 1, 3, 1]
    d = S.xor_distances(counts)
    assert round(d[0]) == 4 + 1 + 9 + 1 and round(d[1]) == 2 * (2 * 1 + 1 * 3) and round(d[2]) == 2 * 2 * 3 and round(d[16]) == 2 * 2


def test_long_chain_has_one_component(spark):
    chain = [0]
    for i in range(60):
        chain.append(chain[-1] ^ (1 << i))
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(chain, chain[1:])], "a bigint, b bigint")
    assert {r.root for r in S.components(edges).collect()} == {0}


def test_one_of_each(spark):
    rows = with_null_ids(messy_rows())
    docs = messy(spark, rows)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    # one row of each component, the one with the smallest id; rows are told apart by their place here
    comp = {r.doc_id: r.component_id for r in S.near_duplicates(messy(spark, [(k, *r[1:]) for k, r in enumerate(rows)])).collect()}
    low = {}
    for k, c in comp.items():
        i = rows[k][0]
        low[c] = min(low.get(c, (True, 0)), (i is None, i or 0))
    want = sorted((None if none else i for none, i in low.values()), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_one_row_stays_of_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c d e", "en", "a"), (1, "a b c d e", "en", "b"), (1, "quite another text than that", "en", "a"),
            (None, "a b c d e", "en", "a"), (None, "only without an id", "en", "a"), (None, "only without an id", "en", "a")]
    kept = S.one_of_each(messy(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "only without an id"), (1, "a b c d e"), (1, "quite another text than that")]


def test_empty_table(spark):
    assert S.near_duplicates(empty(spark)).count() == 0
