"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles (tokens).  Two sets link
when their Jaccard similarity reaches the threshold.

1. Equal sets are one class; one row of each class goes on.
   A sieve looks at the smallest 2 m + 1 token hashes of a set, m being what a
   partner may lack: at least m + 1 of them are in a partner, too (up to the
   partner's own prefix, so the least m of any partner counts).  Sets with
   fewer of them in other sets' prefixes have no partner; only the others are
   read again with all their tokens.
2. The document frequency of every token over the classes puts all tokens in
   one order, rarest first.  A token of one class only can't be shared; a set
   too few of whose tokens are shared has no partner and is done.
3. Prefixes.  Rare tokens are indexed one by one, more frequent ones in
   combinations of two, the most frequent of three.  Frequent tokens are dealt
   to groups by hash, and combinations are made inside a group, so their
   number stays in proportion to the prefix.  A partner misses at most
   ``n - ceil(threshold * n)`` tokens of a set; c tokens of a group of
   k-combinations survive c - k misses with a combination left.  So the prefix
   is extended until the sum over groups of max(0, c - (k - 1)) exceeds the
   misses: then a partner shares a signature.  (Of two partners the one whose
   prefix ends first has all its shared prefix tokens in the other's prefix.)
   Group counts belong to a range of sizes; a set whose partners may be in the
   next range is indexed there, too.
4. Candidates are verified by the exact overlap.  In every bucket first a few
   leaders are compared with all members; members that are connected by then
   need no further look at each other.  In buckets that still hold several
   components every pair across components is verified: small buckets as
   pairs, large ones as pairs of blocks inside tasks.  No bucket is expanded
   into its pairs, and none is cut.
5. Components of the links give each class, and so each document, its id.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import batches_of, release, shuffle_partitions, table
from rivulet.llm.simhash import components
from rivulet.llm.substring_dedup import RUN_BYTES, Rolling, Words
from rivulet.session import drop_path, materialize, scratch_path

SHINGLE = 4
THRESHOLD = 85  # per cent
# document frequencies up to which a token is indexed alone, and in pairs; in threes beyond
RARE, COMMON = 16, 4096
# rounds of leaders before every pair across components is verified
ROUNDS = 3
PAIRS_UP_TO = 32
BLOCK, BLOCK_TOKENS = 256, 1 << 21
# numbers that rows are told apart by before they are shuffled
PLACES = 1 << 20
# parts of the tokens that are shuffled one after another
SLICES = 4
_BASE, _MIX, _MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def misses(n: int, threshold: int = THRESHOLD) -> int:
    """How many tokens of a set of ``n`` a partner can lack."""
    return n * (100 - threshold) // 100


def smallest_size(threshold: int = THRESHOLD) -> int:
    """The smallest set that can link with a different one (of one token more)."""
    n = 1
    while 100 * n < threshold * (n + 1):
        n += 1
    return n


def size_range(n: int, threshold: int = THRESHOLD) -> int:
    """Range r holds the sizes from smallest * 2^r up to below twice that."""
    return (n // smallest_size(threshold)).bit_length() - 1


def groups_in(r: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """(groups, longest combination) in range ``r``: such that every set in it can still complete its prefix.

    A group of pairs loses one token and one of threes two, so both of one number at most three.
    """
    low = smallest_size(threshold) << r
    least = max(smallest_size(threshold), -(-low * threshold // 100))  # sets of the range below that are indexed here, too
    room = least - misses(least, threshold) - 1
    return max(1, min(misses(low, threshold) + 1, room // 3)), 3 if room >= 3 else 2 if room >= 1 else 1


def signatures_of(n: int, tokens: list[int], dfs: list[int], threshold: int = THRESHOLD, rare: int = RARE, common: int = COMMON) -> set[int]:
    """The signatures of a set of ``n`` tokens; ``tokens`` are its shared ones, rarest first, as unsigned 64-bit numbers."""
    out: set[int] = set()
    own = size_range(n, threshold)
    ranges = [own] if 100 * n < threshold * (smallest_size(threshold) << (own + 1)) else [own, own + 1]
    for r in ranges:
        (groups, longest), need = groups_in(r, threshold), misses(n, threshold) + 1 - (n - len(tokens))
        seen: dict[tuple[int, int], list[int]] = {}
        for t, df in zip(tokens, dfs):
            if need <= 0:
                break
            k = min(longest, 1 if df <= rare else 2 if df <= common else 3)
            before = () if k == 1 else seen.setdefault((k, t % groups), [])
            for others in combinations(before, k - 1):
                h = r * 4 + k
                for x in (*others, t):
                    h = ((h ^ x) * _MIX) & _MASK
                    h ^= h >> 31
                out.add(h)
            if k == 1 or len(before) >= k - 1:
                need -= 1
            if k > 1:
                before.append(t)
    return out


def sieve_length(n: int, threshold: int = THRESHOLD) -> int:
    return min(n, 2 * misses(n, threshold) + 1)


def shingle_sets(shingle: int = SHINGLE, sieve_of: int | None = None):
    """Rows (text, others ...) to (n, digest of the set, its tokens in order, others ...); with a threshold only the tokens that the sieve looks at."""
    def run(batches):
        import pyarrow as pa
        words, rolling = Words(), Rolling(_BASE)
        for batch in batches:
            raws = [(t.as_py() or "").encode("utf-8", "replace").lower() for t in batch.column(0)]  # bytes: A-Z only
            for rows, texts in batches_of([list(range(len(raws))), raws], RUN_BYTES):
                words.read(texts)
                n, keys, sets = [], [], []
                for first, count in zip(words.first.tolist(), words.count.tolist()):
                    at = np.arange(first, first + max(count - shingle + 1, min(count, 1)))
                    tokens = np.unique(rolling.between(words.h, at, at + min(shingle, count)))
                    n.append(len(tokens))
                    keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    sets.append(tokens.view(np.int64)[:len(tokens) if sieve_of is None else sieve_length(len(tokens), sieve_of)])
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                others = batch.take(pa.array(rows)).columns[1:]
                yield pa.record_batch([pa.array(n, pa.int32()), pa.array(keys, pa.binary()),
                                       pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets))), *others],
                                      names=["n", "key", "tokens", *batch.schema.names[1:]])
    return run


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _signatures(threshold: int, rare: int, common: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x, sig = [], []
            for i, n, tokens, dfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), _lists(batch.column(3))):
                found = signatures_of(n, tokens.view(np.uint64).tolist(), dfs.tolist(), threshold, rare, common)
                sig += found
                x += [i] * len(found)
            yield pa.record_batch([pa.array(np.array(sig, dtype=np.uint64).view(np.int64)), pa.array(x, pa.int64())], names=["sig", "x"])
    return run


def _verify(threshold: int):
    """Rows (a, b, n of a, n of b, tokens of a, tokens of b) to the pairs that link."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            both = np.fromiter((len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(_lists(batch.column(4)), _lists(batch.column(5)))),
                               dtype=np.int64, count=batch.num_rows)
            good = 100 * both >= threshold * (na.astype(np.int64) + nb - both)
            yield pa.record_batch([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of ``sets`` share."""
    m = len(sets)
    token, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = np.bincount(place, minlength=len(token)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, column = owner[keep], column[place[keep]]
    out = np.zeros((m, m), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 2048
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _cells(threshold: int):
    """Rows (cell, x, root, n, tokens), the rows of a cell together, to a forest of links between roots."""
    def links(rows):
        roots = [r[0] for r in rows]
        if len(set(roots)) < 2:
            return
        n = np.array([r[1] for r in rows], dtype=np.int64)
        both = overlaps([r[2] for r in rows])
        a, b = np.nonzero(np.triu(100 * both >= threshold * (n[:, None] + n[None, :] - both), 1))
        parent = {r: r for r in roots}

        def find(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        for i, j in zip(a.tolist(), b.tolist()):
            p, q = find(roots[i]), find(roots[j])
            if p != q:
                parent[max(p, q)] = min(p, q)
                yield min(roots[i], roots[j]), max(roots[i], roots[j])

    def run(batches):
        import pyarrow as pa
        cell, rows, out = None, [], []
        for batch in batches:
            for c, root, n, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _lists(batch.column(3))):
                if c != cell:
                    out += links(rows)
                    cell, rows = c, []
                rows.append((root, n, tokens.copy()))
            if out:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})
                out = []
        out += links(rows)
        if out:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})
    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets (``x``, ``n``, ``tokens``) link."""
    a = sets.select(F.col("x").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("x").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    fits = 100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    small = pairs.join(a.drop("ta"), "a").join(b.drop("tb"), "b").where(fits).select("a", "b", "na", "nb")
    return small.join(a.drop("na"), "a").join(b.drop("nb"), "b").select("a", "b", "na", "nb", "ta", "tb") \
        .mapInArrow(_verify(threshold), "a bigint, b bigint")


def linked_sets(sets: DataFrame, threshold: int = THRESHOLD, rare: int = RARE, common: int = COMMON, rounds: int = ROUNDS,
                pairs_up_to: int = PAIRS_UP_TO, block: int = BLOCK, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``x``, ``root``: the component of every set that links with another one.

    ``sets`` has ``x`` (unique), ``n`` (tokens of the set) and ``tokens`` and
    ``dfs`` (the shared ones with their frequencies, rarest first).
    """
    spark = sets.sparkSession
    every = materialize(sets.select("x", "n", "tokens", "dfs").mapInArrow(_signatures(threshold, rare, common), "sig bigint, x bigint"), "jaccard-index")
    buckets = materialize(every.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "jaccard-buckets")
    index = materialize(every.join(buckets, "sig"), "jaccard-members").join(sets.select("x", "n"), "x")
    release(spark)

    roots = None
    open_index = index.withColumn("root", F.col("x"))
    for k in range(rounds):
        # leaders: the smallest and the largest number under another hash each round
        order = F.struct(F.xxhash64(F.lit(k), "x").alias("h"), F.col("x"))
        ends = open_index.groupBy("sig").agg(F.min(order)["x"].alias("lo"), F.max(order)["x"].alias("hi"),
                                             F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("sig", "lo", "hi")
        ends = materialize(ends, "jaccard-leaders")
        pairs = open_index.join(ends, "sig").select("x", F.explode(F.array("lo", "hi")).alias("y")).where("x != y") \
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if roots is not None:
            ra, rb = roots.select(F.col("x").alias("a"), F.col("root").alias("_ra")), roots.select(F.col("x").alias("b"), F.col("root").alias("_rb"))
            pairs = pairs.join(ra, "a", "left").join(rb, "b", "left") \
                .where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")
        links = verified(pairs, sets, threshold)
        if roots is not None:
            links = links.unionByName(roots.where("x != root").select(F.col("root").alias("a"), F.col("x").alias("b")))
        roots = materialize(components(links).select(F.col("node").alias("x"), "root"), "jaccard-roots")
        open_index = materialize(open_index.select("sig", "x", "n", "members").join(roots, "x", "left")
                                 .select("sig", "x", "n", "members", F.coalesce("root", "x").alias("root")), "jaccard-open")
        mixed = materialize(open_index.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum("n").alias("total"))
                            .where("r0 != r1").select("sig", "total"), "jaccard-mixed")
        release(spark)
        if mixed.isEmpty():
            return roots
        open_index = open_index.join(mixed, "sig")

    # what is left: every pair across components, in small buckets as pairs
    small = open_index.where(F.col("members") <= pairs_up_to)
    other = small.select("sig", F.col("x").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("n_y"))
    fits = 100 * F.least("n", "n_y") >= threshold * F.greatest("n", "n_y")
    pairs = small.join(other, "sig").where((F.col("x") < F.col("y")) & (F.col("root") != F.col("root_y")) & fits) \
        .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    links = verified(pairs, sets, threshold)
    # in large ones as pairs of blocks
    large = open_index.where(F.col("members") > pairs_up_to).withColumn("blocks", F.greatest(
        F.ceil(F.col("members") / block), F.ceil(F.col("total") / block_tokens)).cast("int"))
    cells = large.withColumn("own", F.pmod(F.xxhash64(F.lit(-1), "x"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select(F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "x", "root")
    cells = materialize(cells, "jaccard-cells")
    mixed = materialize(cells.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("cell"), "jaccard-mixed")
    inside = cells.join(mixed, "cell").join(sets.select("x", "n", "tokens"), "x").select("cell", "root", "n", "tokens") \
        .repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(_cells(threshold), "a bigint, b bigint")
    links = links.unionByName(inside).unionByName(roots.where("x != root").select(F.col("root").alias("a"), F.col("x").alias("b")))
    return components(links).select(F.col("node").alias("x"), "root")


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to a path of its own, for tables that go before the operator ends."""
    path = scratch_path(df.sparkSession, "jaccard")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def by_shared_tokens(sets: DataFrame, value, name: str, slices: int = SLICES) -> DataFrame:
    """``x``, ``n`` and ``v``: ``value`` over a set's tokens ``t`` that other rows hold, too (``df`` rows); one row per set and slice.

    Tokens are dealt to slices by hash, and one slice goes after another, so
    that the disk holds the shuffles of one; every token is in one of them.
    """
    spark, out = sets.sparkSession, None
    for k in range(slices):
        tokens = sets.select("x", "n", F.explode("tokens").alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(slices)) == k)
        shared, path = _written(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
        release(spark)
        part = materialize(tokens.join(shared, "t").groupBy("x", "n").agg(value.alias("v")), name)
        drop_path(spark, path)
        release(spark)
        out = part if out is None else out.unionByName(part)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       threshold: int = THRESHOLD, **options) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest id reachable over links, itself included.
    A text of fewer words than ``shingle`` is one shingle of all its words; a
    null text, or one without words, links with nothing.  Texts of any length
    count whole.  Repeated rows and equal sets link with each other.  A null id
    never is the smallest (a component of null ids only has a null
    ``component_id``).  Other columns of ``docs`` are not read.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    least = smallest_size(threshold)
    rows = docs.select(F.col(text_col).alias("t"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("h"))
    first = rows.mapInArrow(shingle_sets(shingle, threshold), "n int, key binary, tokens array<bigint>, id bigint, h bigint")
    first, first_path = _written(first.withColumn("x", F.monotonically_increasing_id()))
    marks = materialize(first.select("id", "n", "key", "x"), "jaccard-marks")
    classes = materialize(marks.groupBy("key").agg(F.min("id").alias("low"), F.min("x").alias("x"), F.first("n").alias("n")), "jaccard-classes")
    # the sieve, over one row of each class
    sieve, sieve_path = _written(first.where(F.col("n") >= least).join(classes.select("x"), "x", "left_semi").select("x", "n", "id", "h", "tokens"))
    drop_path(spark, first_path)
    release(spark)
    smallest_partner = F.ceil(F.col("n") * threshold / 100)
    through = materialize(by_shared_tokens(sieve, F.count(F.lit(1)), "jaccard-sieved").groupBy("x", "n").agg(F.sum("v").alias("s"))
                          .where(F.col("s") > F.floor(smallest_partner * (100 - threshold) / 100)).select("x"), "jaccard-through")
    release(spark)
    place = F.pmod(F.xxhash64("id", "h"), F.lit(PLACES))
    asked = materialize(sieve.drop("tokens").join(through, "x", "left_semi").withColumn("place", place), "jaccard-asked")
    drop_path(spark, sieve_path)
    # texts that can't be asked for are not shuffled: at most PLACES numbers are broadcast, whatever the input
    near = rows.withColumn("place", place).join(F.broadcast(asked.select("place").distinct()), "place", "left_semi").drop("place")
    # rows that repeat a chosen row bring its tokens again, which changes no set
    again = near.join(asked.select("x", F.col("id").alias("_id"), F.col("h").alias("_h")),
                      (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id"))) \
        .select("t", "x").mapInArrow(shingle_sets(shingle), "n int, key binary, tokens array<bigint>, x bigint")
    chosen, chosen_path = _written(again.select("x", "n", "tokens"))
    release(spark)
    parts = by_shared_tokens(chosen, F.collect_set(F.struct("df", "t")), "jaccard-shared")
    drop_path(spark, chosen_path)
    in_order = F.sort_array(F.flatten(F.collect_list("v")))
    sets = parts.groupBy("x", "n").agg(in_order.alias("o")) \
        .where(100 * F.size("o") >= threshold * F.col("n")) \
        .select("x", "n", F.col("o.t").alias("tokens"), F.col("o.df").alias("dfs"))
    sets = materialize(sets, "jaccard-candidates")
    release(spark)
    roots = linked_sets(sets, threshold, **options)
    member = classes.join(roots, "x", "left").select("key", "low", F.coalesce("root", "x").alias("root"))
    member = materialize(member, "jaccard-classes")
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(member.join(lowest, "root").select("key", "component_id"), "jaccard-components")
    return marks.join(named, "key").select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
