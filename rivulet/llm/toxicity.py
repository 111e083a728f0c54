"""Toxicity by nearest labelled examples.

Labelled texts become TF-IDF vectors of unit length over all words and word
beginnings of the labelled sample; those that do not tell the classes apart
(chi-square) weigh less, none is left out.  Beginnings stand for the forms of a
word that the sample has not seen.  The few terms of the largest weight in all
are a matrix, and a query's products with it a first part of every cosine.  All
others are inverted lists, each in runs of examples that hold the term equally
often, so that a run needs one number and its examples; beside them stands the
largest weight of each term in each block of neighbouring examples.  The k-th
best first part is a floor of the k-th best cosine; a query bounds its cosine
with every block from the maxima and looks into the blocks that can reach the
floor: the neighbours are exact.
Their labels vote by similarity; isotonic regression on the labelled sample,
each row without itself, makes the vote a probability.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import held_out, table
from rivulet.llm.quality import isotonic
from rivulet.session import materialize

# bound of the fit: about so many labelled rows of each class, none longer than this
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 65536
FULL_CHI2 = 30.0  # from here a term has its full weight; chance alone gives one such term in some ten million
LEAST_WEIGHT = 0.1  # share of its weight that any term keeps
HEAD = 2048  # terms kept as a matrix, those of the longest lists
QUERIES = 512  # texts whose products with the matrix are taken together
QUERY_TERMS = 400_000  # fewer texts where they have so many terms
TRIED = 8  # texts of these whose blocks are bounded; the others' are if that spares a quarter of the blocks
ROUNDING = 1e-5  # more than a float32 product of unit vectors is off
TINY = 1e-30  # less than any cosine that is not zero
NEIGHBOURS = 15
BLOCK = 512  # examples in a block, more where that made over BLOCKS of them
BLOCKS = 16
CHUNK = 8  # examples of a run that are read together
EVIDENCE = 3
THRESHOLD = 0.3
SEED = 8
STEMS = (4, 5, 6)  # each a letter longer than the one before
# pieces of text looked up together
RUN_PIECES = 30_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, these marked by a caret."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) >= k)]


def numbered(terms: str) -> dict[str, int]:
    return {t: i for i, t in enumerate(terms.split("\n"))} if terms else {}


class Vocabulary:
    """Terms by word and by beginning; a text is looked up without remembering any word that is not among them."""

    def __init__(self, terms: dict[str, int]):
        self.words = {t: i for t, i in terms.items() if t[0] != "^"}
        self.stems = {t[1:]: i for t, i in terms.items() if t[0] == "^"}
        # term: the longest beginning that goes with it, -1 if none does
        self.up = np.full(len(terms), -1, dtype=np.int32)
        for known, ahead in ((self.words, (w[:STEMS[-1]] for w in self.words)), (self.stems, (s[:-1] for s in self.stems))):
            self.up[np.fromiter(known.values(), np.int64)] = np.fromiter(map(self.stems.get, ahead, repeat(-1)), np.int32)

    def beginning(self, word: str) -> int:
        """The longest known beginning of a word, -1 if there is none."""
        for k in reversed(STEMS):
            found = self.stems.get(word[:k], -1)
            if found >= 0:
                return found
        return -1

    def of(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The terms of all words of each text, given as its lower-cased pieces between white space, and the number of its text."""
        texts = np.arange(len(pieces))
        flat = list(chain.from_iterable(pieces))
        of = np.repeat(texts, [len(x) for x in pieces])
        term = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, count=len(flat))
        # most pieces are a known word; the words of the others are sought
        other = np.flatnonzero(term < 0)
        ends = np.searchsorted(of[other], np.arange(len(pieces) + 1)).tolist()
        other = [flat[i] for i in other.tolist()]
        words = [_LETTERS.findall(" ".join(other[a:b])) for a, b in zip(ends[:-1], ends[1:])]
        flat = list(chain.from_iterable(words))
        found = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, count=len(flat))
        new = np.flatnonzero(found < 0)
        found[new] = [self.beginning(flat[i]) for i in new.tolist()]
        term, of = np.concatenate([term, found]), np.concatenate([of, np.repeat(texts, [len(x) for x in words])])
        all_terms, all_of = [], []
        while len(term):
            known = term >= 0
            term, of = term[known], of[known]
            all_terms.append(term)
            all_of.append(of)
            term = self.up[term]
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (all_terms, all_of))


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), start[1], ..."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _together(vectors):
    """The vectors in lists of at most QUERIES, fewer where they have many terms."""
    some, size = [], 0
    for at, w in vectors:
        some.append((at, w))
        size += len(at)
        if len(some) == QUERIES or size >= QUERY_TERMS:
            yield some
            some, size = [], 0
    if some:
        yield some


def in_runs(term: np.ndarray, level: np.ndarray, row: np.ndarray, terms: int) -> tuple:
    """Postings, those of a term in rising order of rows, as runs of equal level: how many a term has, their levels and lengths, all rows."""
    order = np.lexsort((level, term))
    term, level, row = term[order], level[order], row[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (level[1:] != level[:-1])]))
    return (np.bincount(term[first], minlength=terms).astype(np.int32), level[first],
            np.diff(np.append(first, len(term))).astype(np.int32), row)


def arranged(ids: np.ndarray, at: list, w: list) -> np.ndarray:
    """An order of the examples in which neighbours share their heaviest terms, so that block maxima stay tight."""
    heavy = np.array([[*a[np.argsort(-x, kind="stable")[:2]], -1, -1][:2] for a, x in zip(at, w)], dtype=np.int64).reshape(len(ids), 2)
    return np.lexsort((ids, heavy[:, 1], heavy[:, 0]))


@dataclass
class Index:
    """Labelled examples under block-max lists."""
    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray           # how many labelled rows an example stands for
    examples: np.ndarray | None   # examples x terms, unit length
    postings: tuple | None = None  # in place of these, in this order: what ``in_runs`` gives of them
    scale: np.ndarray | None = None  # example: its weight of a term is this times the level of its run times the term's idf
    empty_rate: float = 0.5       # toxic share of labelled rows without any of the terms
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    slot: np.ndarray = field(init=False)        # term: its column of the head, -1 if it has none
    head: np.ndarray = field(init=False)        # examples x terms of the longest lists
    block: int = field(init=False)              # examples in a block
    block_max: np.ndarray = field(init=False)   # terms x blocks: the largest weight, none in the head
    lists: np.ndarray = field(init=False)       # term: its first chunk, and the end of the last term's
    chunks: np.ndarray = field(init=False)      # chunk: its examples, filled up with numbers that no example has
    level_of: np.ndarray = field(init=False)    # chunk: the number of the level of all its examples
    levels: np.ndarray = field(init=False)      # the levels by their numbers
    reach: np.ndarray = field(init=False)       # chunk: the blocks of its first and its last example

    def __post_init__(self):
        n, terms = len(self.ids), len(self.idf)
        if self.postings is None:
            order = arranged(self.ids, [np.flatnonzero(x) for x in self.examples], [x[x != 0] for x in self.examples])
            self.ids, self.labels, self.weights, self.examples = (
                x[order] for x in (self.ids, self.labels, self.weights, self.examples))
            self.examples = self.examples.astype(np.float32)
            term, row = np.nonzero(self.examples.T)
            self.postings = in_runs(term, self.examples[row, term] / self.idf[term], row, terms)
            self.scale = np.ones(n)
        runs, level, length, row = self.postings
        self.postings = None
        term = np.repeat(np.arange(terms, dtype=np.int32), runs)
        top = np.argsort(-np.bincount(term, weights=length, minlength=terms), kind="stable")[:HEAD]
        self.slot = np.full(terms, -1, dtype=np.int32)
        self.slot[top] = np.arange(len(top))
        weight = lambda r: np.repeat(level[r] * self.idf[term[r]], length[r])
        self.head = np.zeros((n, len(top)), dtype=np.float32)
        tail = self.slot[term] < 0
        beside = np.repeat(tail, length)
        rows = row[~beside]
        self.head[rows, np.repeat(self.slot[term[~tail]], length[~tail])] = weight(~tail) * self.scale[rows]
        rows, count = row[beside], length[tail].astype(np.int64)
        self.block = max(BLOCK, -(-n // BLOCKS))
        self.block_max = np.zeros((terms, -(-n // self.block)), dtype=np.float32)
        np.maximum.at(self.block_max.reshape(-1), np.repeat(term[tail].astype(np.int64) * self.block_max.shape[1], count) + rows // self.block,
                      (weight(tail) * self.scale[rows]).astype(np.float32))
        size = -(-count // CHUNK)
        start = np.cumsum(size) - size
        self.chunks = np.tile(n + np.arange(CHUNK, dtype=np.uint16 if n + CHUNK <= 1 << 16 else np.int32), (int(size.sum()), 1))
        self.chunks.reshape(-1)[_spans(start * CHUNK, count)] = rows
        self.levels, number = np.unique(level[tail], return_inverse=True)
        self.level_of = np.repeat(number.astype(np.min_scalar_type(len(self.levels))), size)
        last = np.full(len(self.chunks), CHUNK - 1)
        last[start + size - 1] = (count - 1) % CHUNK
        self.reach = np.stack([self.chunks[:, 0], self.chunks[np.arange(len(last)), last]]) // np.asarray(self.block, self.chunks.dtype)
        self.lists = np.append(0, np.cumsum(np.bincount(term[tail], weights=size, minlength=terms))).astype(np.int32)

    @property
    def rows(self) -> np.ndarray:
        """The example of each posting."""
        return self.chunks[self.chunks < len(self.ids)]

    @classmethod
    def of(cls, fitted: dict) -> Index:
        """The index that ``fit`` has learned."""
        return cls(**{k: v for k, v in fitted.items() if k != "built"} | {"terms": numbered(fitted["terms"])}, examples=None)

    @classmethod
    def shared(cls, fitted: dict) -> tuple[Index, Vocabulary]:
        """The index and its vocabulary, kept with the broadcast value: a Python worker builds them once for all its tasks."""
        if "built" not in fitted:
            index = cls.of(fitted)
            fitted["built"] = index, Vocabulary(index.terms)
        return fitted["built"]

    def vector(self, text: str | None, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text, of unit length; empty if it has none of the terms."""
        return next(self.vectors([text], known))

    def vectors(self, texts, known: Vocabulary):
        """``vector`` of each text; the pieces of several texts are looked up and counted together."""
        for at, counts, of, ends in self._counted(texts, known):
            w = (1 + np.log(counts)) * self.idf[at]
            w /= np.sqrt(np.bincount(of, weights=w * w, minlength=len(ends) - 1))[of]
            for a, b in zip(ends[:-1], ends[1:]):
                yield at[a:b], w[a:b]

    def unit(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of one text, of unit length."""
        w = (1 + np.log(counts)) * self.idf[at]
        return at, w / np.sqrt((w * w).sum())

    def counts(self, texts, known: Vocabulary):
        """Terms of each text and how often it has them."""
        for at, counts, _, ends in self._counted(texts, known):
            for a, b in zip(ends[:-1], ends[1:]):
                yield at[a:b], counts[a:b]

    def _counted(self, texts, known: Vocabulary):
        some: list[list[str]] = []
        size = 0
        for text in texts:
            some.append((text or "").lower().split())
            size += len(some[-1])
            if size >= RUN_PIECES:
                yield self._count(some, known)
                some, size = [], 0
        yield self._count(some, known)

    def _count(self, some: list[list[str]], known: Vocabulary):
        terms, of = known.of(some)
        key, counts = np.unique(of * len(self.idf) + terms, return_counts=True)
        of, at = np.divmod(key, max(1, len(self.idf)))
        return at, counts, of, np.searchsorted(of, np.arange(len(some) + 1))

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int | None = None):
        """Positions and cosines of the k nearest examples, with all that tie with the k-th; only positive cosines."""
        return next(self.nearest_each([(at, w)], k, [without]))

    def nearest_each(self, vectors, k: int = NEIGHBOURS, without: list | None = None):
        """``nearest`` of each vector, an empty one near nothing."""
        done = 0
        for some in _together(vectors):
            at, w = (np.concatenate(x) for x in zip(*some))
            of = np.repeat(np.arange(len(some)), [len(a) for a, _ in some])
            column = self.slot[at]
            inside = column >= 0
            head = np.searchsorted(of[inside], np.arange(len(some) + 1))
            queries = np.zeros((len(some), self.head.shape[1]), dtype=np.float32)
            queries[of[inside], column[inside]] = w[inside]
            column, in_head = column[inside], w[inside]
            tail = np.searchsorted(of[~inside], np.arange(len(some) + 1))
            at, w = at[~inside], w[~inside]
            start = self.lists[at]
            count = self.lists[at + 1] - start
            lists = at, w, start, count, w * self.idf[at]
            tried = spared = 0
            for i, first in enumerate(queries @ self.head.T):
                if not len(some[i][0]) or not len(first):
                    yield np.zeros(0, np.int64), np.zeros(0)
                    continue
                if without:
                    first[self.ids == without[done + i]] = -2
                at, w, start, count, share = (x[tail[i]:tail[i + 1]] for x in lists)
                wanted = None
                if tried < TRIED or 4 * spared >= tried:
                    wanted = self._wanted(first, at, w, k)
                    tried, spared = tried + 1, spared + 1 - wanted.mean()
                h = slice(head[i], head[i + 1])
                yield self._nearest(first, column[h], in_head[h], start, count, share, wanted, k)
            done += len(some)

    def _wanted(self, first: np.ndarray, at: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
        """Whether a block can hold one of the k nearest."""
        kth = max(0, len(first) - k)
        bounds = np.maximum.reduceat(first, np.arange(0, len(first), self.block)) + w @ self.block_max[at]
        return bounds >= np.partition(first, kth)[kth] - 2 * ROUNDING

    def _nearest(self, first: np.ndarray, column: np.ndarray, w: np.ndarray, start: np.ndarray, count: np.ndarray, share: np.ndarray,
                 wanted: np.ndarray | None, k: int):
        n = len(first)
        kth = max(0, n - k)
        chunk, share = _spans(start, count), np.repeat(share, count)
        if wanted is not None and not wanted.all():
            before = np.append(0, np.cumsum(wanted))
            look = before[self.reach[1, chunk].astype(np.int64) + 1] > before[self.reach[0, chunk]]
            chunk, share = chunk[look], share[look]
        share *= self.levels[self.level_of[chunk]]
        # each example of a chunk, the numbers that fill it up, too, with the chunk's share
        rows = np.take(self.chunks, chunk, axis=0).reshape(-1)
        rest = np.bincount(rows, weights=np.repeat(share, CHUNK), minlength=n + CHUNK)[:n] * self.scale
        near = first + rest
        found = np.flatnonzero(near >= max(np.partition(near, kth)[kth] - ROUNDING, TINY))
        sims = rest[found] + (self.head[found][:, column] * w).sum(axis=1)
        if len(found) > k:
            keep = sims >= np.partition(sims, -k)[-k] - 1e-9
            found, sims = found[keep], sims[keep]
        order = np.lexsort((found, -sims))
        return found[order], sims[order]

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        if not len(found):
            return -1.0
        w = sims * sims * self.weights[found]
        return float((w * self.labels[found]).sum() / w.sum())

    def score(self, vote: float) -> float:
        return self.empty_rate if vote < 0 else float(np.interp(vote, self.knots, self.values))


def _count_terms(batches):
    import pyarrow as pa
    for batch in batches:
        terms, toxic = [], []
        for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
            found = set(chain.from_iterable(map(terms_of, set(words_of(t.as_py())))))
            terms.extend(found)
            toxic.extend([y] * len(found))
        yield pa.record_batch([pa.array(terms, pa.string()), pa.array(toxic, pa.int32())], names=["term", "y"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
        seed: int = SEED) -> dict | None:
    """What ``Index.of`` needs for an index over about ``sample_rows`` labelled rows of each class that are not held out.

    Rows are drawn at one rate per class by a seeded hash of the id and count
    1/rate each.  Null labels and ids are left out; an id labelled more than
    once counts with its largest label.  None if there is no labelled row.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))) \
        .groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not sizes:
        return None
    rates = {y: min(1.0, sample_rows / n) for y, n in sizes.items()}
    rate = F.create_map(*[F.lit(x) for y, r in rates.items() for x in (y, r)])[F.col("_y")]
    unit = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = marked.where(unit < rate)  # about 2 * sample_rows ids, whatever the size of the corpus
    base = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t"))
    sample = materialize(base.where(F.coalesce(F.octet_length("_t"), F.lit(0)) <= sample_bytes)
                         .join(F.broadcast(drawn), "_id"), "toxic-sample")
    n = {y: 0 for y in (0, 1)} | {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sum(n.values()):
        return None
    counted = sample.select("_t", "_y").mapInArrow(_count_terms, "term string, y int").groupBy("term").agg(
        F.sum((F.col("y") > 0).cast("double")).alias("a"), F.count(F.lit(1)).cast("double").alias("df"))
    pos, total = float(n[1]), float(n[0] + n[1])
    neg = total - pos
    # the terms of the sample, so bounded; frequent ones first, so that what most lookups touch lies together
    counted = counted.toArrow().sort_by([("df", "descending"), ("term", "ascending")])
    terms = "\n".join(counted["term"].to_pylist())
    a, df = counted["a"].to_numpy(), counted["df"].to_numpy()
    del counted
    b = df - a
    chi2 = total * (a * (neg - b) - b * (pos - a)) ** 2 / (df * np.maximum(total - df, 1.0) * max(pos, 1.0) * max(neg, 1.0))
    idf = np.log((1 + total) / df) * np.clip(chi2 / FULL_CHI2, LEAST_WEIGHT, 1.0)
    bare = docs.sparkSession.sparkContext.broadcast((terms, idf))

    def vectors(batches):
        import pyarrow as pa
        index = object.__new__(Index)
        names, index.idf = bare.value
        known = Vocabulary(numbered(names))
        for batch in batches:
            found = list(index.counts((t.as_py() for t in batch.column(1)), known))
            yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array([f[i].astype(np.int32).tobytes() for f in found], pa.binary())
                                                                       for i in (0, 1))], names=["id", "y", "at", "n"])

    # the sample, so bounded; rows without any of the terms only count
    sparse = materialize(sample.select("_id", "_t", "_y").mapInArrow(vectors, "id bigint, y int, at binary, n binary"), "toxic-vectors")
    weigh = lambda y: 1.0 / rates[y]
    none = [(weigh(r.y), float(r.y > 0)) for r in sparse.where(F.octet_length("at") == 0).select("y").collect()]
    full = sparse.where(F.octet_length("at") > 0).toArrow()
    marks = full["y"].to_pylist()
    bare.destroy()
    ids, at, counts = full["id"].to_numpy().astype(np.int64), *([np.frombuffer(x.as_py(), np.int32) for x in full[c]] for c in ("at", "n"))
    del full
    w = [(1 + np.log(c)) * idf[a] for a, c in zip(at, counts)]
    length = np.array([np.sqrt((x * x).sum()) for x in w])
    order = arranged(ids, at, [(x / y).astype(np.float32) for x, y in zip(w, length)])
    del w
    at, counts = [at[i] for i in order], [counts[i] for i in order]
    row = np.repeat(np.arange(len(ids), dtype=np.uint16 if len(ids) < 1 << 16 else np.int32), [len(a) for a in at])
    runs, level, run, row = in_runs(*(np.concatenate([np.zeros(0, np.int32), *x]) for x in (at, counts)), row, len(idf))
    index = {"terms": terms, "idf": idf, "ids": ids[order], "labels": np.array([float(y > 0) for y in marks])[order],
             "weights": np.array([weigh(y) for y in marks], dtype=float)[order],
             "postings": (runs, (1 + np.log(level)).astype(np.float32), run, row), "scale": 1 / length[order]}
    del at, counts, run, row
    total_w = sum(w for w, _ in none)
    index["empty_rate"] = (sum(w * y for w, y in none) + 0.5) / (total_w + 1.0)
    if marks:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def voted(batches):
            import pyarrow as pa
            index, _ = Index.shared(shared.value)
            for batch in batches:
                each = (index.unit(*(np.frombuffer(x.as_py(), np.int32) for x in pair)) for pair in zip(batch.column(2), batch.column(3)))
                votes = [index.vote(*f) for f in index.nearest_each(each, without=batch.column(0).to_pylist())]
                yield pa.record_batch([pa.array(votes, pa.float64()), batch.column(1)], names=["vote", "y"])

        votes = [(r.vote, weigh(r.y), weigh(r.y) * float(r.y > 0)) for r in
                 sparse.where(F.octet_length("at") > 0).mapInArrow(voted, "vote double, y int").where("vote >= 0").collect()]
        shared.destroy()
        if votes:
            v = pd.DataFrame(votes, columns=["x", "w", "p"]).groupby("x", as_index=False).sum().sort_values("x")
            index["knots"], index["values"] = isotonic(v["x"].to_numpy(), v["w"].to_numpy(), v["p"].to_numpy())
    return index


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``, ``evidence``.

    ``evidence`` lists the nearest examples (id, cosine, label).  A text
    without any of the words, also an empty or null one, gets the toxic share
    of the labelled texts like it and no evidence.  Without labelled rows every
    score is 0.5.  Repeated rows get equal results.  A text of any length is
    read whole; only labelled examples have a bound of size.  Examples that tie
    with the last of the nearest vote, too.  Other columns of ``docs`` are not
    read.  An empty table gives an empty result.
    """
    index = fit(docs, labels, id_col, text_col, label_col, **fitting)
    # arrays bounded by the sample
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        import pyarrow as pa
        index, known = Index.shared(shared.value) if shared.value else (None, None)
        for batch in batches:
            score, evidence = [], []
            if index is None:
                score, evidence = [0.5] * len(batch), [[]] * len(batch)
            for found, sims in index.nearest_each(index.vectors((t.as_py() for t in batch.column(1)), known)) if index else ():
                score.append(index.score(index.vote(found, sims)))
                evidence.append([{"id": int(index.ids[f]), "cosine": float(s), "label": int(index.labels[f])}
                                 for f, s in zip(found[:EVIDENCE], sims[:EVIDENCE])])
            kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.record_batch([batch.column(0), pa.array(score, pa.float64()), pa.array(evidence, kind)],
                                  names=["_id", "score", "evidence"])

    out = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")) \
        .mapInArrow(run, "_id bigint, score double, evidence array<struct<id: bigint, cosine: double, label: int>>")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
