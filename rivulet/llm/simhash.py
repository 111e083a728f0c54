"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A 64-bit fingerprint per whole text: bit i is set if it is set in over half
   of the XXH64 values of the text's word shingles.
2. Bits that are correlated over all distinct fingerprints are put together in
   four groups of 16.  For each group the exact number of pairs at every
   distance is known from the counts of its 65,536 values (an XOR
   autocorrelation, so its cost is fixed).
3. Parts are unions of groups.  If part i may differ in at most t_i bits and
   the (t_i + 1) add up to distance + 1, a pair within the distance must keep
   the threshold of some part.  Over every way to join groups to parts, a dynamic
   programme gives the thresholds of least estimated cost (candidates and
   probes).  A part may get -1: it is not looked at.
4. Every distinct fingerprint is listed under its part's value and probes the
   values within the threshold; each bucket is verified by the bit distance.
   A bucket larger than ``BLOCK`` is dealt to tasks as pairs of blocks.  A
   bucket yields a spanning forest of its links, never all pairs.
5. Components by alternating large-star and small-star steps, each written.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import first_of_each, shuffle_partitions, table, told_apart
from rivulet.session import materialize

SHINGLE = 3
DISTANCE = 3
SEED = 42
GROUPS, GROUP_BITS = 4, 16
BLOCK = 4096
# one probe row costs about as much as verifying so many candidates
PROBE_COST = 100.0
SMALL = 12


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at:min(at + (1 << 16), n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        h = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``_id``, ``fp`` (the 64 bits as a signed long) for every row; a null text has no words."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            fps = np.array([fingerprint_of(t.as_py() or "", shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")) \
        .mapInArrow(run, "_id bigint, fp bigint")


def correlated_groups(both: np.ndarray, n: int) -> list[list[int]]:
    """Four groups of 16 bits, each grown from the bit most correlated with the rest.

    ``both[i, j]`` counts the fingerprints with bits i and j set.
    """
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(64)), []
    while free:
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < GROUP_BITS:
            b = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            free.remove(b)
        groups.append(sorted(group))
    return groups


def xor_distances(counts: np.ndarray) -> np.ndarray:
    """Ordered pairs at each bit distance, from the counts of all 2^16 values (Walsh-Hadamard transform)."""
    x, width = counts.astype(np.float64), 1
    for _ in range(2):
        width = 1
        while width < len(x):
            y = x.reshape(-1, 2, width)
            x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(-1)
            width *= 2
        x = x * x if _ == 0 else x / len(x)
    bits = np.bitwise_count(np.arange(len(x), dtype=np.uint64)).astype(np.int64)
    return np.maximum(np.bincount(bits, weights=x), 0)


def _layouts(groups: list[int]):
    """Every way to join the groups to parts."""
    if not groups:
        yield []
        return
    first, rest = groups[0], groups[1:]
    for k in range(len(rest) + 1):
        for others in combinations(rest, k):
            left = [g for g in rest if g not in others]
            for tail in _layouts(left):
                yield [[first, *others], *tail]


def _masks(bits: int, threshold: int) -> int:
    total, c = 0, 1
    for k in range(threshold + 1):
        total += c
        c = c * (bits - k) // (k + 1)
    return total


def allocate(distances: list[np.ndarray], n: int, distance: int) -> list[tuple[list[int], int]]:
    """The parts (lists of group numbers) and thresholds of least estimated cost.

    Candidates of a part with threshold t: pairs at distance <= t in it; for
    joined groups the distances of the groups are taken as independent.
    """
    best: tuple[float, list] = (float("inf"), [])
    for layout in _layouts(list(range(len(distances)))):
        # dp[u]: least cost with u of the distance + 1 units of (threshold + 1) handed out
        dp: list[tuple[float, list]] = [(0.0, [])] + [(float("inf"), [])] * (distance + 1)
        for part in layout:
            pairs = np.ones(1)
            for g in part:
                pairs = np.convolve(pairs, distances[g] / max(1.0, distances[g].sum()))
            bits = GROUP_BITS * len(part)
            new = [(c, [*ts, (part, -1)]) for c, ts in dp]
            for t in range(min(distance, 3) + 1):
                cost = float(pairs[:t + 1].sum()) * n * n / 2 + PROBE_COST * n * (1 + _masks(bits, t)) / 2
                for u in range(distance + 1 - t):
                    if dp[u][0] + cost < new[u + t + 1][0]:
                        new[u + t + 1] = (dp[u][0] + cost, [*dp[u][1], (part, t)])
            dp = new
        if dp[distance + 1][0] < best[0]:
            best = dp[distance + 1]
    return [(part, t) for part, t in best[1] if t >= 0]


def _links_in(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct values ``fps``: breadth-first from each unseen value."""
    left, out = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found, left = left[near], left[~near]
                out.extend((int(x), int(y)) for y in found)
                queue.extend(found)
    return out


def _verify(distance: int):
    def run(batches):
        import pyarrow as pa

        def edges(cells: np.ndarray, fps: np.ndarray):
            starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            sizes = np.diff(np.append(starts, len(cells)))
            a, b = [], []
            small = np.repeat(sizes <= SMALL, sizes)
            of = np.repeat(np.arange(len(starts)), sizes)
            at = np.flatnonzero(small)
            for d in range(1, SMALL):
                at = at[at + d < len(fps)]
                at = at[of[at] == of[at + d]]
                if not len(at):
                    break
                x, y = fps[at], fps[at + d]
                ok = (np.bitwise_count(x ^ y) <= distance) & (x != y)
                a.append(x[ok])
                b.append(y[ok])
            for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
                found = _links_in(np.unique(fps[s:s + n]), distance)
                if found:
                    a.append(np.array([f[0] for f in found], dtype=np.uint64))
                    b.append(np.array([f[1] for f in found], dtype=np.uint64))
            x = np.concatenate(a).view(np.int64) if a else np.zeros(0, np.int64)
            y = np.concatenate(b).view(np.int64) if b else np.zeros(0, np.int64)
            return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        cells, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:  # sorted by cell; a cell holds at most two blocks, and its start may lie in the batch before
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(cells):
                continue
            cut = int(np.searchsorted(cells, cells[-1]))
            if cut:
                yield edges(cells[:cut], fps[:cut])
                cells, fps = cells[cut:], fps[cut:]
        if len(cells):
            yield edges(cells, fps)
    return run


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints (column ``fp``) that connect all that are within ``distance``."""
    spark = distinct.sparkSession

    def together(batches):
        both, n = np.zeros((64, 64)), 0
        for pdf in batches:
            for k in range(0, len(pdf), 1 << 16):
                fps = pdf["fp"].to_numpy(np.int64)[k:k + (1 << 16)]
                bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        if n:
            i, j = np.divmod(np.arange(4096), 64)
            yield pd.DataFrame({"i": i, "j": j, "c": both.reshape(-1).astype(np.int64), "n": n})

    counted = distinct.select("fp").mapInPandas(together, "i int, j int, c long, n long") \
        .groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()  # 64 x 64 rows
    if not counted:
        return spark.createDataFrame([], "a bigint, b bigint")
    both = np.zeros((64, 64))
    for r in counted:
        both[r.i, r.j] = r.c
    n = int(counted[0].n)
    groups = correlated_groups(both, n)

    def value(bits):
        out = F.lit(0).cast("bigint")
        for k, b in enumerate(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("bigint")), k))
        return out

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << GROUP_BITS)
        counts[pdf["v"].to_numpy()] = pdf["n"].to_numpy()
        return pd.DataFrame({"g": [pdf["g"].iat[0]], "d": [xor_distances(counts)]})

    # at most 65,536 values for each of the four groups
    values = distinct.select(F.posexplode(F.array(*[value(g) for g in groups])).alias("g", "v")) \
        .groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    distances = [np.array(r.d) for r in values.groupBy("g").applyInPandas(spread, "g int, d array<double>").orderBy("g").collect()]
    parts = allocate(distances, n, distance)

    listed = None
    for number, (part, threshold) in enumerate(parts):
        bits = [b for g in part for b in groups[g]]
        masks = [m for k in range(1, threshold + 1) for m in combinations(range(len(bits)), k)]
        key = value(bits)
        rows = distinct.select("fp", key.alias("key"))
        if masks:
            # of two values that differ in a mask just the one with its lowest bit set probes the other
            probes = F.array(*[F.struct(F.lit(sum(1 << i for i in m)).cast("bigint").alias("m"),
                                        F.lit(1 << min(m)).cast("bigint").alias("low")) for m in masks])
            probing = distinct.select("fp", key.alias("key"), F.explode(probes).alias("p")) \
                .where(F.col("key").bitwiseAND(F.col("p.low")) != 0) \
                .select("fp", F.col("key").bitwiseXOR(F.col("p.m")).alias("key"))
            rows = rows.unionByName(probing)
        rows = rows.select("fp", F.lit(number).alias("part"), "key")
        listed = rows if listed is None else listed.unionByName(rows)
    # larger buckets than a block: how many blocks
    large = listed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block) \
        .select("part", "key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    cells = listed.join(large, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select(F.xxhash64("part", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    cells = cells.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_verify(distance), "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of ``edges`` (a < b).

    Alternating large-star and small-star steps.  Every round is written to the
    shared folder; it ends when a round changes nothing.
    """
    def state(e):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    e = materialize(edges.select("a", "b"), "star")
    before = state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")) \
            .where("a != b").distinct()
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(low, large["b"] == low["u"])
        e = materialize(
            small.select(F.col("m").alias("a"), F.explode(F.array(F.col("a"), F.col("b"))).alias("b")).where("a != b").distinct(),
            "star")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, ``fp``, ``fingerprint``, ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most
    ``distance`` bits.  Texts without words (also null ones) have the zero
    fingerprint and link like any other.  A null id never is the smallest (a
    component of null ids only has a null ``component_id``).  Repeated rows
    share everything.  Other columns of ``docs`` are not read.  An empty table
    gives an empty result.  Components that have not settled after 64 rounds
    (chains of some 2^64 links) raise an error.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("_id").alias("low")), "simhash-distinct")
    stars = components(links(distinct, distance, block))
    member = distinct.join(stars, distinct["fp"] == stars["node"], "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    out = marked.join(member.select("fp", "root"), "fp").join(lowest, "root")
    return out.select(F.col("_id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: exactly one of each component.

    It is the one with the smallest id; a null id only stays where no row of
    the component has one.  Of rows that repeat the smallest id one stays, by a
    written row number.  Null texts and texts without words share the zero
    fingerprint.  Whole texts are read, whatever their length.  An empty table
    gives an empty result.
    """
    rows, key = told_apart(docs, id_col)
    near = near_duplicates(rows, key, text_col, shingle, distance)
    if key == id_col:
        gone = near.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone"))
        return rows.join(gone, rows[key] == gone["_gone"], "left_anti")
    ids = rows.select(F.col(key).alias("_key"), F.col(id_col).alias("_id"))
    members = materialize(near.select(F.col(key).alias("_key"), "component_id").join(ids, "_key"), "simhash-members")
    gone = members.join(first_of_each(members, "component_id"), "component_id").where("_key != _stays") \
        .select(F.col("_key").alias("_gone"))
    return rows.join(gone, rows[key] == gone["_gone"], "left_anti").drop(key)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("fp")
