"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. Statistics of each whole text (shares of character kinds, word lengths,
   repetition ...), one pass, written as one short array per document.
2. Random Fourier features of the standardised statistics approximate a
   Gaussian kernel.
3. Each task sums its own part of the ridge normal equations; the parts are
   added by an aggregate and solved once (their size is fixed by the number of
   features, not by the data).
4. Raw scores of the training rows are counted on a fixed grid; isotonic
   regression (pool adjacent violators) on the grid makes them probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import free_name, held_out, table
from rivulet.session import materialize

FEATURES = 256
BANDWIDTH = 3.0
RIDGE = 1e-3
GRID = 2000
THRESHOLD = 0.7
SEED = 5

_KINDS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 comma or stop, 7 other ASCII mark, 8 above ASCII
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = (8 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n"
                  else 4 if _c.isspace() else 6 if _c in ",." else 7 if 32 < _b < 127 else 0)
N_STATS = 24


def statistics(text: str) -> list[float]:
    """Fixed-length description of a whole text; the empty text has a defined one (zeros and one flag)."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * (N_STATS - 1) + [1.0]
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, weights=by_byte, minlength=9) / n
    words = raw.split()
    n_words = max(1, len(words))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    same_next = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    sentences = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    used = by_byte[by_byte > 0] / n
    return [
        np.log1p(n), np.log1p(n_words), np.log1p(len(lines)), *kinds[1:9].tolist(),
        float(lengths.mean()), float(lengths.std()), float(lengths.max() > 40),
        distinct / n_words, pairs / max(1, len(words) - 1), same_next / n_words,
        len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)) / 50.0,
        sentences / n_words, float(-(used * np.log2(used)).sum()),
        raw.count(b"|") / n_words, raw.count(b"!!") / n_words, 0.0,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``stats`` for every row."""
    base = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            stats = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["_id", "stats"])
    return base.mapInArrow(run, "_id bigint, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray   # raw score
    values: np.ndarray  # probability at it, not falling

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.hstack([wave, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over grid cells; one knot per pooled block, at its mean ``x``."""
    blocks: list[list[float]] = []
    for a, w, p in zip(x, weight, positive):
        if w <= 0:
            continue
        blocks.append([a * w, w, p])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return (np.array([b[0] / b[1] for b in blocks]),
            # one half row of each class keeps a small block from claiming certainty
            np.array([(b[2] + 0.5) / (b[1] + 1.0) for b in blocks]))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        n_features: int = FEATURES, bandwidth: float = BANDWIDTH, ridge: float = RIDGE,
        seed: int = SEED) -> Model | None:
    """Fit on the rows of ``stats`` that have a label and are not held out.

    Null labels and ids are left out; an id labelled more than once counts
    with its largest label.  None if there is no labelled row.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))) \
        .groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    train = materialize(stats.join(marked, "_id").select("stats", "_y"), "quality-train")
    moments = train.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()  # one row per statistic
    if not moments:
        return None
    mean = np.array([r.m for r in moments])
    scale = np.array([r.s if r.s and r.s > 1e-9 else 1.0 for r in moments])
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / bandwidth, (N_STATS, n_features)),
                  rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.zeros(1), np.zeros(1))
    size = n_features + 1

    def part(batches):
        a, b, n = np.zeros((size, size)), np.zeros(size), 0
        for pdf in batches:
            for k in range(0, len(pdf), 4096):
                rows = pdf.iloc[k:k + 4096]
                x = model.features(np.stack(rows["stats"].to_numpy()))
                y = rows["_y"].to_numpy()
                a += x.T @ x
                b += x.T @ y
                n += len(rows)
        if n:
            yield pd.DataFrame({"i": np.arange(size), "row": [np.append(r, v) for r, v in zip(a, b)], "n": n})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iat[0]], "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)],
                             "n": [pdf["n"].sum()]})

    schema = "i int, row array<double>, n long"
    # each row of the equations is added up by itself: a task holds one row from each part
    rows = train.mapInPandas(part, schema).groupBy("i").applyInPandas(add, schema).orderBy("i").collect()
    both = np.array([r.row for r in rows])
    a, b, n = both[:, :-1], both[:, -1], rows[0].n
    penalty = np.eye(size) * ridge * n
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(a + penalty, b)

    def grid(batches):
        for pdf in batches:
            raw = model.raw(np.stack(pdf["stats"].to_numpy())) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"cell": np.clip(np.floor((raw + 1) / 3 * GRID), 0, GRID - 1).astype(np.int64),
                                "raw": raw, "y": pdf["_y"]})

    cells = train.mapInPandas(grid, "cell long, raw double, y double").groupBy("cell").agg(
        F.avg("raw").alias("x"), F.count(F.lit(1)).alias("w"), F.sum("y").alias("p")).orderBy("cell").collect()  # at most GRID rows
    model.knots, model.values = isotonic(*(np.array([r[k] for r in cells], dtype=float) for k in ("x", "w", "p")))
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``.

    A null text is scored as the empty text, which has statistics like any
    other; a text of any length is read whole.  Only the text makes the score.
    Without any labelled row every score is 0.5.  Repeated rows get equal
    scores.  Other columns of ``docs`` are not read.  An empty table gives an
    empty result.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "quality-stats")
    model = fit(stats, labels, "doc_id", label_col, **fitting)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            stacked = np.asarray(batch.column(1).flatten()).reshape(n, N_STATS)
            score = model.score(stacked) if model and n else np.full(n, 0.5)
            yield pa.record_batch([batch.column(0), pa.array(score, pa.float64())], names=["_id", "score"])

    scored = stats.mapInArrow(run, "_id bigint, score double")
    return scored.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``.

    The rows are written once with their statistics, which both the fit and
    the scores read; no text is shuffled or read twice.  A null text is judged
    as the empty text, long texts are read whole, rows that repeat an id each
    by their own text.  Without any labelled row all stay.  An empty table gives
    an empty result.
    """
    name = free_name(docs, "_statistics")

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or "") for t in texts], dtype=object)

    rows = materialize(docs.withColumn(name, described(F.col(text_col))), "quality-rows")
    model = fit(rows.select(F.col(id_col).cast("bigint").alias("_id"), F.col(name).alias("stats")), labels, "doc_id", label_col, **fitting)
    if not model:
        return rows.drop(name)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_numpy())) if len(stats) else np.zeros(0))

    return rows.where(score(F.col(name)) >= threshold).drop(name)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
