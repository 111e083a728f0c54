import random
import struct
import zlib
from collections import defaultdict

from rivulet.llm import packing as P
from tests.llm.helpers import empty, messy, messy_rows, with_null_ids


def ids_of(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.tokenizer_path())
    return {(i, x): t.encode(x or "", add_special_tokens=False).ids + [1] for i, x, *_ in rows}


def check(rows, got, window):
    ids = ids_of(rows)
    crc = lambda p: zlib.crc32(struct.pack(f"<{len(p)}I", *p))
    want = sorted((str(i), s, len(x[s:s + window]), crc(x[s:s + window]), len(x))
                  for i, t, *_ in rows for x in [ids[(i, t)]] for s in range(0, len(x), window))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sum(sum(n for _, n in p) for p in seqs.values()) / (len(seqs) * window)


def test_against_the_tokenizer(spark):
    rows = with_null_ids(messy_rows())
    rows += [(200, "Áb \u0001<|endoftext|> x y \x1cz don't 12   q", "en", "a"), (201, "﻿\x85　", None, None)]
    got = P.pack(messy(spark, rows)).collect()
    assert check(rows, got, P.WINDOW) > 0.9


def test_several_bins(spark):
    rows = messy_rows()
    got = P.pack(messy(spark, rows), window=64, bin_pieces=100).collect()
    assert check(rows, got, 64) > 0.95
    assert len({r.sequence_id >> 32 for r in got}) > 1


def brute_best_fit(lengths, window):
    room, out = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
            out.append(min(fits))
        else:
            room.append(window - n)
            out.append(window)
    return out


def test_the_tightest_window_is_found():
    rnd = random.Random(5)
    for window in (1, 7, 64, 100):
        lengths = sorted((rnd.randint(1, window) for _ in range(400)), reverse=True)
        wins, offsets = P.best_fit_decreasing(lengths, window)
        # the room before each piece is the same whichever of equally tight windows is used
        assert [window - o for o in offsets] == brute_best_fit(lengths, window)
        fill = defaultdict(int)
        for w, n in zip(wins, lengths):
            fill[w] += n
        assert max(fill.values()) <= window


def test_empty_table(spark):
    assert P.pack(empty(spark)).count() == 0
