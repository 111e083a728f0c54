import random
import re

import pytest

from pyspark.sql import functions as F

from rivulet.llm import jaccard_join as J
from tests.llm.helpers import empty, messy, messy_rows, prose, with_null_ids


def brute_set(text, k=4):
    t = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots_of(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def links(sets, threshold):
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                yield j, i


def brute(rows, threshold=85):
    sets = [brute_set(r[1]) for r in rows]
    roots = roots_of(len(rows), links(sets, threshold))
    out = []
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None]
        out.append((r[0], len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in J.jaccard_components(df, **options).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def near_copies(seed=2, groups=6, of=25, words=(8, 9, 12, 30, 70, 200)):
    """Groups whose members differ from each other by some words, around the threshold."""
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        base = prose(rnd, words[g % len(words)]).split()
        for _ in range(of):
            w = list(base)
            for _ in range(rnd.randint(0, 2 + len(w) // 60)):
                at = rnd.randrange(len(w))
                w[at:at + rnd.randint(0, 1)] = [rnd.choice(["x", "y", rnd.choice(base)])]
            rows.append((len(rows) * 3 + 1, " ".join(w), "en", "a"))
    return rows


def test_against_brute_force(spark):
    rows = with_null_ids(messy_rows())
    assert got(messy(spark, rows)) == brute(rows)


@pytest.mark.parametrize("options", [{}, {"rare": 0, "common": 0}, {"rare": 1, "common": 10, "rounds": 1, "pairs_up_to": 2, "block": 4},
                                     {"rare": 0, "common": 10**9, "rounds": 1, "block_tokens": 300, "pairs_up_to": 3}])
def test_groups_of_near_copies(spark, options):
    """Single tokens, pairs and threes; leaders, pairs and blocks: each way alone finds every link."""
    rows = near_copies(seed=len(options))
    assert got(messy(spark, rows, clash=False), **options) == brute(rows)


def test_other_thresholds(spark):
    rows = near_copies(seed=8, groups=4, of=12)
    for threshold in (50, 95):
        assert got(messy(spark, rows, clash=False), threshold=threshold) == brute(rows, threshold)


def test_partners_share_a_signature():
    """Whatever the classes of tokens are, no pair above the threshold is without a common signature."""
    rnd = random.Random(4)
    for trial in range(1500):
        threshold = rnd.choice([50, 70, 80, 85, 90])
        n = rnd.choice([rnd.randint(J.smallest_size(threshold), 40), rnd.randint(40, 400)])
        universe = [rnd.getrandbits(64) for _ in range(2 * n)]
        df = {t: rnd.choice([2, 16, 17, 4096, 5000]) if trial % 3 else 5000 for t in universe}
        a = rnd.sample(universe, n)
        off, more = rnd.randint(0, J.misses(n, threshold)), rnd.randint(0, J.misses(n, threshold) + 1)
        b = a[off:] + [t for t in universe if t not in set(a)][:more]
        both = len(set(a) & set(b))
        if 100 * both < threshold * (len(a) + len(b) - both) or min(len(a), len(b)) < J.smallest_size(threshold):
            continue
        alone = rnd.randint(0, min(off, 2))  # tokens no other set has are known only by their number

        def sigs(s, drop):
            s = sorted(s, key=lambda t: (df[t], t))
            kept = [t for t in s if t not in drop]
            return J.signatures_of(len(s), kept, [df[t] for t in kept], threshold)

        assert sigs(a, set(a[:alone])) & sigs(b, set()), (n, off, more, threshold)


def test_groups_leave_room_for_every_prefix():
    for threshold in (50, 60, 70, 85, 90, 99):
        for n in range(J.smallest_size(threshold), 5000):
            own = J.size_range(n, threshold)
            for r in (own, own + 1):
                if r == own or 100 * n >= threshold * (J.smallest_size(threshold) << r):
                    groups, longest = J.groups_in(r, threshold)
                    assert n - groups * (0, 1, 3)[longest - 1] >= J.misses(n, threshold) + 1


def test_sieve_keeps_partners():
    rnd = random.Random(6)
    for _ in range(3000):
        threshold = rnd.choice([50, 70, 85, 95])
        n = rnd.randint(J.smallest_size(threshold), 120)
        a = rnd.sample(range(10**6), n)
        off = rnd.randint(0, J.misses(n, threshold))
        b = a[off:] + [10**6 + i for i in rnd.sample(range(10**6), rnd.randint(0, J.misses(n, threshold) + 2))]
        a, b = ({t * 0x9E3779B97F4A7C15 % 2**64 for t in s} for s in (a, b))
        if 100 * len(a & b) >= threshold * len(a | b):
            pa, pb = (set(sorted(s)[:J.sieve_length(len(s), threshold)]) for s in (a, b))
            for s in (a, b):
                partner = -(-len(s) * threshold // 100)
                assert len(pa & pb) > J.misses(partner, threshold)


def test_signatures_grow_with_the_prefix_only():
    rnd = random.Random(1)
    for df in (2, 100, 10**6):
        n = 20000
        tokens = [rnd.getrandbits(64) for _ in range(n)]
        assert len(J.signatures_of(n, tokens, [df] * n)) < 3 * n


def test_overlaps_are_exact():
    import numpy as np
    rnd = random.Random(3)
    sets = [np.array(sorted(rnd.sample(range(9000), rnd.randint(1, 4000)))) for _ in range(12)]
    both = J.overlaps(sets)
    assert all(both[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(12) for j in range(i))


def test_empty_table(spark):
    assert J.jaccard_components(empty(spark)).count() == 0


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(2, None), (1, ""), (3, " \n"), (4, "a b"), (5, "a  b")], "doc_id bigint, text string")
    assert got(df) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


def test_shared_tokens_come_slice_by_slice(spark):
    from rivulet.llm.jaccard_join import by_shared_tokens
    sets = {x: sorted({(x * 7 + i * i) % 900 for i in range(40)}) for x in range(60)}
    df = {}
    for tokens in sets.values():
        for t in tokens:
            df[t] = df.get(t, 0) + 1
    frame = spark.createDataFrame([(x, len(t), t) for x, t in sets.items()], "x bigint, n int, tokens array<bigint>")
    got, slices = {}, {}
    for r in by_shared_tokens(frame, F.collect_set(F.struct("df", "t")), "t", 3).collect():
        got.setdefault(r["x"], []).extend((v["df"], v["t"]) for v in r["v"])
        slices[r["x"]] = slices.get(r["x"], 0) + 1
    assert max(slices.values()) == 3
    assert {x: sorted(v) for x, v in got.items()} == {x: sorted((df[t], t) for t in ts if df[t] > 1) for x, ts in sets.items()}
