"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document.  D is a perfect
difference set modulo the period P: for any two word positions i, j there is a
shift below P that brings both into D.  So two equal windows, wherever they
start, share an aligned anchor of WINDOW - P + 1 words that begins at a cover
position in both documents.  Only these anchors (6 of 31 positions) are
hashed and shuffled.

1. Whole copies: of equal texts (128-bit hash) only the smallest id takes part
   below; the others lose every window to it.
2. Anchors by hash; those that occur in two different texts or more are kept
   (partial aggregate), and their places are joined back.
3. Extension: around each kept place the full windows that contain the anchor
   are hashed (128 bits).  The smallest id of each window decides.
4. Places of windows that a smaller id also has are joined to their document,
   which drops the words they cover.

Frequent anchors and windows are aggregated before the shuffle and joined back
by joins that adaptive execution can split; no group is gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import batches_of, release, table
from rivulet.session import materialize

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # fixed values: a perfect difference set modulo 31
# bytes of text hashed together
RUN_BYTES = 256 << 10
_NO_ID = (1 << 63) - 1

_BASE1, _BASE2, _BYTES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


class Rolling:
    """Hashes of runs of numbers: sum of h[i+k] * base^k modulo 2^64, scrambled."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def between(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(h) + 1)
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * self.up[:len(h)], out=sums[1:])
        out = (sums[ends] - sums[starts]) * self.down[starts]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


class Words:
    """The words of several texts, hashed without making an object of each.

    Words are runs of bytes other than the six ASCII spaces.  ``first`` and
    ``count`` give each text's place among the words of all.
    """

    def __init__(self):
        self.rolling = Rolling(_BYTES)
        self.number = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[[9, 10, 11, 12, 13, 32]] = False

    def read(self, raws: list[bytes]) -> None:
        raw = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
        inside = self.is_word[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[::2], edge[1::2]
        self.h = self.rolling.between(self.number[raw], starts, ends)
        begins = np.cumsum([0, *(len(r) + 1 for r in raws)])
        at = np.searchsorted(starts, begins)
        self.first, self.count = at[:-1], np.diff(at)
        # of each word: its text, and its place in it
        self.of = np.repeat(np.arange(len(raws)), self.count)
        self.place = np.arange(len(self.h)) - self.first[self.of]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()  # bytes split at the six ASCII spaces only


def _raw(column) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "replace") for t in column]


def _anchors(window: int, period: int, cover: tuple[int, ...], distinct: bool):
    length = window - period + 1

    def run(batches):
        import pyarrow as pa
        words, rolling = Words(), Rolling(_BASE1)
        covered = np.isin(np.arange(period), cover)
        for batch in batches:
            for keys, raws in batches_of([batch.column(0).to_pylist(), _raw(batch.column(1))], RUN_BYTES):
                words.read(raws)
                n = words.count[words.of]
                at = np.flatnonzero((n >= window) & (words.place + length <= n) & covered[words.place % period])
                cols = [rolling.between(words.h, at, at + length).view(np.int64), np.array(keys, dtype=np.int64)[words.of[at]]]
                if not distinct:
                    cols.append(words.place[at].astype(np.int32))
                yield pa.record_batch([pa.array(c) for c in cols], names=["h", "key", "at"][:len(cols)])
    return run


def _windows(window: int, period: int):
    """Full windows around the kept anchors: (w1, w2, id, key, start)."""
    def run(batches):
        import pyarrow as pa
        words, one, two = Words(), Rolling(_BASE1), Rolling(_BASE2)
        for batch in batches:
            anchors = [np.asarray(a.values, dtype=np.int64) for a in batch.column(3)]
            for ids, keys, found, raws in batches_of(
                    [batch.column(0).to_pylist(), batch.column(1).to_pylist(), anchors, _raw(batch.column(2))], RUN_BYTES):
                words.read(raws)
                of = np.repeat(np.arange(len(raws)), [len(f) for f in found])
                at, n = np.concatenate(found), len(words.h)
                first = words.first[of]
                opens = np.bincount(first + np.maximum(at - (period - 1), 0), minlength=n + 1)
                closes = np.bincount(first + np.minimum(at, words.count[of] - window) + 1, minlength=n + 1)
                at = np.flatnonzero(np.cumsum(opens - closes)[:n] > 0)
                of = words.of[at]
                cols = [one.between(words.h, at, at + window).view(np.int64),
                        two.between(words.h ^ (words.h >> np.uint64(32)), at, at + window).view(np.int64),
                        np.array(ids, dtype=np.int64)[of], np.array(keys, dtype=np.int64)[of], words.place[at].astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in cols], names=["w1", "w2", "id", "key", "at"])
    return run


def _kept(window: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, copy in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = words_of(text.as_py())
                left = words
                if copy.as_py() and len(words) >= window:
                    left = []
                elif starts.is_valid and len(starts.values):
                    at, n = np.asarray(starts.values, dtype=np.int64), len(words) + 1
                    cover = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + window, minlength=n))
                    left = [words[k] for k in np.flatnonzero(cover[:-1] == 0)]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8"))
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                   pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])
    return run


def repeated_windows(docs: DataFrame, texts: DataFrame, window: int = WINDOW, period: int = PERIOD,
                     cover: tuple[int, ...] = COVER) -> DataFrame:
    """``id``, ``key``, ``starts``: the first words of the windows of a text that a smaller id also has.

    ``docs`` has ``id``, ``key``, ``key2``, ``t``; ``texts`` the smallest ``id`` of each ``key``, ``key2``.
    """
    spark = docs.sparkSession
    words = docs.select("key", "t")
    shared = words.mapInArrow(_anchors(window, period, cover, True), "h bigint, key bigint") \
        .groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("h")
    places = words.mapInArrow(_anchors(window, period, cover, False), "h bigint, key bigint, at int")
    # a place once for all copies of a text; per text never more than its own words
    anchors = materialize(places.join(shared, "h").groupBy("key", "at").agg(F.lit(1).alias("_"))
                          .groupBy("key").agg(F.collect_list("at").alias("anchors")), "substring-anchors")
    release(spark)
    near = docs.join(texts.join(anchors, "key"), ["id", "key", "key2"]).select("id", "key", "t", "anchors")
    full = materialize(near.mapInArrow(_windows(window, period), "w1 bigint, w2 bigint, id bigint, key bigint, at int"),
                       "substring-windows")
    release(spark)
    first = full.groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    out = materialize(full.join(first, ["w1", "w2"]).where("id > lo").groupBy("id", "key")
                      .agg(F.collect_set("at").alias("starts")), "substring-starts")
    release(spark)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space).

    A word goes if a window of its document covers it whose words also start
    in a document with a smaller id; this is judged on the input.  Null and
    shorter texts lose nothing.  A null id counts as larger than every id.
    Rows that repeat an id are one document's: they don't remove each other's
    words (of two equal anchors in different texts with one 64-bit text hash
    none would be seen; at 10^10 texts some ten such pairs are to be expected).  Other columns of ``docs`` are not read.  An empty table gives an
    empty result.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"),
                       F.xxhash64(text_col).alias("key"), F.xxhash64(F.lit(1), text_col).alias("key2"),
                       F.col(text_col).alias("t"))
    texts = materialize(base.groupBy("key", "key2").agg(F.min("id").alias("id")), "substring-texts")
    starts = repeated_windows(base, texts, window, period, cover)
    found = texts.withColumnRenamed("id", "low").join(starts.withColumnRenamed("id", "low"), ["low", "key"], "left")
    out = base.join(found, ["key", "key2"]).select("id", "t", "starts", (F.col("id") > F.col("low")).alias("copy")).mapInArrow(
        _kept(window), "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS lo FROM g),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM m WHERE lo < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d),
s AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept, count(*) AS n_kept
      FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.j = r.j GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
