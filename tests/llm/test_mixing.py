import random
import re
from collections import defaultdict

import numpy as np
import pytest

from rivulet.llm import mixing as M
from tests.llm.helpers import empty, messy, messy_rows, with_null_ids


def brute_targets(sizes):
    """Weights in turn; what is above twice a source's size is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        t = {s: 2 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in order}
        above = [s for s in free if t[s] > 2 * sizes[s]]
        if not above:
            return t
        capped.update(above)


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for i, t, _, s in rows:
        by_id[i].append((size(t), s))
    taken = defaultdict(int)
    for r in got:
        sources = [s for n, s in by_id[r.doc_id] if n == r["size"] and sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-6 * (1 + r.target)]
        assert sources
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.taken == r["size"] * r.times
        taken[sources[0]] += r.taken
    return sizes, want, taken


def test_against_brute_force(spark):
    rows = with_null_ids(messy_rows())
    got = M.mix(messy(spark, rows)).collect()
    sizes, want, taken = check(rows, got)
    for s in sizes:
        longest = max(len((t or "").split()) for _, t, _, x in rows if x == s)
        assert abs(taken[s] - want[s]) <= max(1, longest)


def test_targets_are_met_to_the_word(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 400)), "en", rnd.choice("abcdef")) for i in range(600)]
    got = M.mix(messy(spark, rows, clash=False)).collect()
    sizes, want, taken = check(rows, got)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = {r.doc_id: r.taken for r in M.mix(messy(spark, rows[::-1], clash=False)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_one_length_shared_by_all_is_split_exactly(spark):
    rows = [(i, "a b c", "en", "s1" if i % 4 else "s0") for i in range(400)]
    old, M.RANK_ROWS = M.RANK_ROWS, 16
    try:
        got = M.mix(messy(spark, rows, clash=False)).collect()
    finally:
        M.RANK_ROWS = old
    sizes, want, taken = check(rows, got)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3


@pytest.mark.parametrize("seed", range(6))
def test_subset_sum_is_best_where_it_is_exact(seed):
    rnd = np.random.default_rng(seed)
    lengths = np.unique(rnd.integers(1, 60, 6)).astype(np.int64)
    counts = rnd.integers(0, 4, len(lengths)).astype(np.int64)
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * int(n) for s in sums for k in range(c + 1)}
    for budget in range(0, int((lengths * counts).sum()) + 2, 7):
        take = M.subset_sum(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_subset_sum_with_large_budgets():
    rnd = np.random.default_rng(3)
    lengths = np.unique(rnd.integers(1, 20000, 900)).astype(np.int64)
    counts = rnd.integers(1, 50, len(lengths)).astype(np.int64)
    total = int((lengths * counts).sum())
    for share in (0.01, 0.3, 0.77, 0.999):
        take = M.subset_sum(lengths, counts, int(total * share))
        assert (take <= counts).all() and abs(int((take * lengths).sum()) - int(total * share)) <= 1


def test_long_documents_fill_what_longest_first_would_miss():
    lengths, counts = np.array([30000, 50000], dtype=np.int64), np.array([2, 1], dtype=np.int64)
    assert M.subset_sum(lengths, counts, 60000).tolist() == [2, 0]
    # only the whole budget as one knapsack finds this one
    lengths, counts = np.array([70001, 90000, 110003], dtype=np.int64), np.array([7, 5, 3], dtype=np.int64)
    want = 3 * 70001 + 5 * 90000 + 2 * 110003
    assert int((M.subset_sum(lengths, counts, want) * lengths).sum()) == want


@pytest.mark.parametrize("seed", range(5))
def test_a_wider_window_is_best_where_a_narrow_one_misses(seed, monkeypatch):
    monkeypatch.setattr(M, "DP_WORDS", 4)
    rnd = np.random.default_rng(seed)
    lengths = np.unique(rnd.integers(20, 90, 5) * 3).astype(np.int64)
    counts = rnd.integers(1, 4, len(lengths)).astype(np.int64)
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * int(n) for s in sums for k in range(c + 1)}
    for budget in range(1, int((lengths * counts).sum()) + 2, 11):
        take = M.subset_sum(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_what_is_taken_beforehand_is_spread_over_the_lengths(monkeypatch):
    monkeypatch.setattr(M, "DP_WORDS", 2000)
    lengths = np.arange(1, 1001, dtype=np.int64)
    take = M.subset_sum(lengths, np.ones(1000, dtype=np.int64), 250000)
    assert int((take * lengths).sum()) == 250000
    assert all(0.4 < take[k:k + 100].mean() < 0.6 for k in range(300, 1000, 100))


@pytest.mark.parametrize("nulls", [False, True])
def test_mixed_rows(spark, nulls):
    rows = with_null_ids(messy_rows()) if nulls else messy_rows()
    docs = messy(spark, rows)
    out = M.mixed(docs)
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in M.mix(docs).collect():
        times[r.doc_id] += r.times
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert dict(got) == {i: k for i, k in times.items() if k}


def test_empty_table(spark):
    assert M.mix(empty(spark)).count() == 0 and M.mixed(empty(spark)).count() == 0
