import re

import pytest

from rivulet.llm import substring_dedup as S
from tests.llm.helpers import empty, messy, messy_rows, with_null_ids


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    first = {}
    rank = lambda i: (i is None, i or 0)
    for (i, *_), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if key not in first or rank(i) < rank(first[key]):
                first[key] = i
    out = []
    for (i, *_), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if rank(first[tuple(w[k:k + window])]) < rank(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = with_null_ids(messy_rows())
    got = S.substring_dedup(messy(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 50)


@pytest.mark.parametrize("window,period,cover", [(50, 31, S.COVER), (10, 7, (1, 2, 4)), (13, 13, (0, 1, 3, 9)), (50, 1, (0,))])
def test_any_offset_is_found(spark, window, period, cover):
    passage = [f"p{i}" for i in range(window)]
    rows = [(0, " ".join(passage), "en", "a")]
    for shift in range(35):
        rows.append((shift + 1, " ".join([f"u{shift}x{i}" for i in range(shift)] + passage + ["tail"]), "en", "a"))
    got = S.substring_dedup(messy(spark, rows, clash=False), window=window, period=period, cover=cover).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, window)


def test_the_cover_meets_every_shift():
    p = S.PERIOD
    for i in range(p):
        for j in range(p):
            assert any((i + d) % p in S.COVER and (j + d) % p in S.COVER for d in range(p))


def test_words_are_hashed_as_they_stand():
    words = S.Words()
    raws = ["a  bc a".encode(), b"", "é\x1c  bc".encode(), b" \n"]
    words.read(raws)
    assert words.count.tolist() == [3, 0, 2, 0] and words.place.tolist() == [0, 1, 2, 0, 1]
    h = words.h.tolist()
    assert h[0] == h[2] and h[1] == h[4] and len(set(h)) == 3


def test_empty_table(spark):
    assert S.substring_dedup(empty(spark)).count() == 0
