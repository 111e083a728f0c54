"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes: the exact number of words of every document, written once.
2. Targets: each source's share of the whole budget by its weight, at most
   ``max_epochs`` times its size; what is above is shared again by weight.
   (All sources not at their limit get ``level * weight``; the level follows
   from one ordered pass over the sources.)
3. Fitting: a source is taken whole as often as it fits.  For the rest,
   documents are only counted by exact length, and a bounded-knapsack dynamic
   programme over those counts finds how many of each length make up the
   remaining budget as nearly as possible.
4. Selection: of each length, the documents with the smallest seeded hash.

Step 3 sees one row per (source, length).  D different lengths need at least
D*D/2 words, so even a source of 10^13 words has under 5 million of them.
Step 4 deals the documents of one (source, length) by ranges of their hash,
so a length that a third of all rows share is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import WORD, free_name, table, text_of, told_apart
from rivulet.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
# the dynamic programme first fits this many words exactly, four times as many as long as the budget is missed ...
DP_WORDS = 1 << 14
# ... up to the whole budget or this many words (or eight of the longest documents)
MOST_WORDS = 1 << 24
# about so many documents of one length are ranked together
RANK_ROWS = 20000
_HASH_RANGE = 1 << 62


def targets(sources: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size: one row per source) with a column ``target``.

    Sources in code-point order, null last, get the weights in turn.  Sources
    reach their limit in the order of limit/weight; with the first j of them at
    their limit the others stand at level (total - their limits) / (their weights).
    The level is that of the first j at which the next source stays below its limit.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    limits = sources.withColumn("_w", w).withColumn("_limit", F.col("source_size") * F.lit(float(max_epochs)))
    by_limit = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    rest_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / rest_w
    out = limits.withColumn("_level", level)
    # the level holds from the first source on that stays below its limit
    first = F.min(F.when(F.col("_level") * F.col("_w") < F.col("_limit"), F.struct(F.col("_limit") / F.col("_w"), "_level"))
                  ).over(everything)["_level"]
    return out.withColumn("target", F.least(F.col("_limit"), F.coalesce(first * F.col("_w"), F.col("_limit")))
                          ).select("source", "source_size", "target")


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (whole numbers above 0) to take so that their sum is nearest ``budget``; exact.

    ``reach`` has a bit for every sum that can be made.  Binary splitting makes
    few items of many equal ones.  Every so many items ``reach`` is kept, and
    what lies between is made again on the way back.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    if not len(lengths) or budget <= 0:
        return take
    limit = int(min(budget + int(lengths.max()), int((lengths * counts).sum())))
    mask = (1 << (limit + 1)) - 1
    items = []
    for i in np.argsort(lengths, kind="stable"):
        n, part = min(int(counts[i]), limit // int(lengths[i])), 1
        while n > 0:
            items.append((i, min(part, n)))
            n -= part
            part *= 2
    nearest = int(np.gcd.reduce(lengths))
    nearest = {budget // nearest * nearest, -(-budget // nearest) * nearest}
    goals = [g for g in nearest if abs(g - budget) == min(abs(x - budget) for x in nearest)]
    gap = max(1, int(len(items) ** 0.5))
    reach, used, stops = 1, 0, []
    for i, k in items:
        if used % gap == 0:
            stops.append(reach)
        reach = (reach | (reach << (int(lengths[i]) * k))) & mask
        used += 1
        if any((reach >> g) & 1 for g in goals):
            break
    low = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> budget
    high = budget + ((above & -above).bit_length() - 1) if above else None
    goal = low if high is None or budget - low <= high - budget else high
    for block in range(len(stops) - 1, -1, -1):
        mine = items[block * gap:min(used, (block + 1) * gap)]
        before = [stops[block]]
        for i, k in mine[:-1]:
            before.append((before[-1] | (before[-1] << (int(lengths[i]) * k))) & mask)
        for (i, k), known in zip(reversed(mine), reversed(before)):
            if not (known >> goal) & 1:
                take[i] += k
                goal -= k * int(lengths[i])
    return take


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length to take so that their sum is as near ``budget`` as can be.

    All but a window of the budget is taken as an even, seeded share over the
    documents in order of length, and the window is fitted by an exact bounded
    knapsack over those left.  A miss opens a wider window, so less is taken
    beforehand, until it holds the whole budget: then no choice is nearer.
    Only budgets above ``MOST_WORDS`` (and eight of the longest documents) keep
    a share beforehand in the last try.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.astype(np.int64).copy()
    long = lengths > 0
    sizes, there = lengths[long].astype(np.int64), counts[long].astype(np.int64)
    start = np.random.default_rng(seed).random()
    most = max(MOST_WORDS, 8 * int(sizes.max()))
    step = int(np.gcd.reduce(sizes))
    least = min(budget % step, -budget % step)  # no sum is nearer
    window, best, miss = max(DP_WORDS, 2 * int(sizes.max())), None, None
    while True:
        share = max(0, budget - window) / total
        upto = np.floor(np.append(0, np.cumsum(there)) * share + start).astype(np.int64)
        first = np.minimum(np.diff(upto), there)
        rest = budget - int((sizes * first).sum())
        found = first + knapsack(sizes, there - first, rest)
        off = abs(budget - int((sizes * found).sum()))
        if best is None or off < miss:
            best, miss = found, off
        if miss <= least or window >= min(budget, most):
            break
        window *= 4
    take = np.zeros(len(lengths), dtype=np.int64)
    take[long] = best
    return take


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken``, ``times``.

    ``times`` is how often the mix takes the document whole, ``taken`` the words
    that makes.  A null text has no words.  A null source is a source of its
    own, the last one.  A document without words is taken as often as its
    source is taken whole.  Equal lengths are ordered by a seeded hash of id,
    size and source, so reruns agree; rows that repeat an id tie there and are
    told apart by the order they were written in.  Other columns of ``docs``
    are not read.  Texts of any length are counted whole; a source of which no
    sum of documents meets the target gets the nearest.  An empty table gives an
    empty result.
    """
    return _mix(docs, id_col, text_col, source_col, None, weights, share, max_epochs, seed).drop("_row")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, key_col: str | None,
         weights=WEIGHTS, share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``mix`` and ``_row``, their ``key_col`` (or a number)."""
    sized = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("size"),
        (F.col(key_col) if key_col else F.monotonically_increasing_id()).alias("_row"))
    sized = materialize(sized.select(
        "*",
        F.shiftright(F.xxhash64(F.lit(seed), "_id", "size", "source"), 1).bitwiseAND(F.lit(_HASH_RANGE - 1)).alias("_h")),
        "mix-sizes")
    hist = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goals = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                    weights, share, max_epochs)
    lengths = hist.alias("h").join(goals.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source"))) \
        .select("h.source", "h.size", "h.n", "g.source_size", "g.target")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        whole, words = 0, int(pdf["source_size"].iat[0])
        goal = float(pdf["target"].iat[0])
        if words:
            whole = int(min(max_epochs, (goal + 0.5) // words))
        rest = int(round(goal - whole * words)) if whole < max_epochs else 0
        pdf["whole"] = np.int64(whole)
        pdf["quota"] = subset_sum(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), rest, seed)
        return pdf

    quotas = materialize(lengths.groupBy("source").applyInPandas(
        fit, "source string, size bigint, n bigint, source_size bigint, target double, whole bigint, quota bigint"),
        "mix-quotas")
    # Documents of one (source, length) lie in equal ranges of the hash; whole ranges are in or out, one range is ranked.
    picked = sized.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))
                                   & (F.col("d.size") == F.col("q.size"))) \
        .select("d.*", "q.n", "q.source_size", "q.target", "q.whole", "q.quota") \
        .withColumn("_ranges", F.ceil(F.col("n") / F.lit(RANK_ROWS)).cast("bigint")) \
        .withColumn("_range", F.floor(F.col("_h") / F.lit(float(_HASH_RANGE)) * F.col("_ranges")).cast("bigint"))
    partial = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    per_range = picked.where(partial).groupBy("source", "size", "_range").agg(F.count(F.lit(1)).alias("_in"))
    # one row per RANK_ROWS documents of one length
    up_to = Window.partitionBy("source", "size").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.withColumn("_before", F.coalesce(F.sum("_in").over(up_to), F.lit(0)))
    ranked = picked.where(partial).alias("p").join(
        per_range.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p.size") == F.col("r.size"))
        & (F.col("p._range") == F.col("r._range"))) \
        .select("p.*", "r._before", "r._in")
    in_range = Window.partitionBy("source", "size", "_range").orderBy("_h", "_row")
    cut = ranked.where((F.col("_before") < F.col("quota")) & (F.col("_before") + F.col("_in") > F.col("quota"))) \
        .withColumn("_extra", (F.row_number().over(in_range) <= F.col("quota") - F.col("_before")).cast("bigint"))
    rest = ranked.where((F.col("_before") >= F.col("quota")) | (F.col("_before") + F.col("_in") <= F.col("quota"))) \
        .withColumn("_extra", (F.col("_before") < F.col("quota")).cast("bigint"))
    plain = picked.where(~partial).withColumn("_extra", (F.col("quota") > 0).cast("bigint"))
    cols = ["_row", "_id", "size", "source_size", "target", "whole", "_extra"]
    out = plain.select(*cols).unionByName(cut.select(*cols)).unionByName(rest.select(*cols))
    times = F.col("whole") + F.col("_extra")
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target",
                      (F.col("size") * times).alias("taken"), times.alias("times"), "_row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as ``mix`` takes that row.

    Rows that repeat an id, or have none, are told apart by a written row
    number, so each source gets what ``mix`` gives it.  Null texts, null sources
    and long texts are as in ``mix``.  An empty table gives an empty result.
    """
    rows, key = told_apart(docs, id_col)
    times = _mix(rows, id_col, text_col, source_col, key, **how).where("times > 0") \
        .select(F.col("_row").alias("_mix_row"), F.col("times").cast("int").alias("_mix_times"))
    copy = free_name(docs, "_mix_copy")
    out = rows.join(times, rows[key] == times["_mix_row"])
    return out.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), times["_mix_times"])).alias(copy)).drop(copy)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
