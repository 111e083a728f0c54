"""The trie of conversation prefixes by fixed-length block hashing.

1. The turns of every conversation are cut into blocks of ``BLOCK`` turns.  A
   block has a digest; the prefix up to a block is named by the sum of the
   digests of its blocks (each digested with its number, so that order
   counts).  Sums make the name of a prefix a running sum, which is computed
   over ranges of the sorted table: a conversation of any length is spread
   over tasks.
2. Conversations are grouped by these names, block by block: copies of any
   number are one row from here on.
3. Where all that goes on after a prefix goes on with one and the same block,
   the nodes of that block are known already.  Only blocks that diverge from
   siblings are opened and grouped again turn by turn.

The figures of subtrees need no walk over the tree.  A node is owned by its
smallest member; what a conversation owns is the lower end of its path.  Every
conversation saves the bytes of its turns above that end, so the bytes saved
below a node are one sum over its members, and so is the number of leaves
(each childless node is one member's own).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import shuffle_partitions, table
from rivulet.session import materialize

BLOCK = 4
SHARE_EVERY, SHARE_MOST = 5, 8
# ids joined to one text before a node's texts meet
CHUNK_IDS = 4096
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def running_sums(df: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with the columns ``sums`` replaced by their running sums within ``key`` in the given order.

    The table is sorted by ranges; a key of any size runs over several of
    them.  Sums are made within a range, and each range is told the sum of its
    first key in the ranges before it (one row per range).  ``key`` must not be null.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = materialize(df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
                         .withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    edges = ranged.groupBy("_range").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    tails = ranged.join(F.broadcast(edges), "_range").where(F.col(key) == F.col("_hi")) \
        .groupBy("_range", "_lo", "_hi").agg(*[F.sum(s).alias(s) for s in sums])
    # one row per range
    by_key, by_range = Window.partitionBy("_hi").orderBy("_range"), Window.orderBy("_range")
    carried = tails.select("_range", "_lo", "_hi", *[F.sum(s).over(by_key).alias(f"_sum_{s}") for s in sums]) \
        .select("_range", F.col("_lo").alias("_first"), F.lag("_hi").over(by_range).alias("_before"),
                *[F.lag(f"_sum_{s}").over(by_range).alias(f"_carry_{s}") for s in sums]) \
        .where(F.col("_before") == F.col("_first")).drop("_before")
    here = Window.partitionBy("_range", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(carried.withColumnRenamed("_range", "_r")),
                      (F.col("_range") == F.col("_r")) & (F.col(key) == F.col("_first")), "left")
    kept = [F.col(c) for c in df.columns if c not in sums]
    return out.select(*kept, *[(F.sum(s).over(here) + F.coalesce(f"_carry_{s}", F.lit(0))).cast(df.schema[s].dataType).alias(s) for s in sums])


def numbered_turns(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``c``, ``pos`` (from 1), ``dig`` and ``bytes`` of every turn; null turns come first, equal turn numbers by their digest."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("c"), F.col(turn_col).alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("dig"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("pos"))
    return running_sums(turns, "c", ["turn", "dig"], ["pos"]).select("c", "pos", "dig", "bytes")


def rebuilt(turns: DataFrame, every: int = SHARE_EVERY, most: int = SHARE_MOST):
    """(ids, turns) of the rebuilt conversations.

    Conversation c is the first h turns of conversation c - c % ``every`` and
    then its own turns after the first h; h = crc32(c as decimal text) % (``most`` + 1).
    """
    turns = materialize(turns, "turns")
    c = F.col("c")
    ids = turns.groupBy("c").agg(F.max("pos").alias("n")) \
        .select("c", "n", (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % (most + 1)).alias("h"))
    ids = materialize(ids, "conversations")
    based = ids.alias("i").join(ids.select(F.col("c").alias("_b"), F.col("n").alias("_bn")), F.col("base") == F.col("_b"), "left") \
        .select("i.c", "base", "h", F.least("h", F.coalesce("_bn", F.lit(0))).alias("taken"))
    based = materialize(based, "bases")
    heads = turns.where((c % every == 0) & (F.col("pos") <= most)).withColumnRenamed("c", "_c") \
        .join(based, F.col("_c") == F.col("base")).where(F.col("pos") <= F.col("taken")).select("c", "pos", "dig", "bytes")
    own = turns.join(based, "c").where(F.col("pos") > F.col("h")) \
        .select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "dig", "bytes")
    return ids.select("c"), heads.unionByName(own)


def _key(*parts):
    return F.md5(F.concat_ws(",", *parts))


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block of a conversation: ``c``, ``j``, ``above`` and ``name`` (prefixes before and with it), ``digs``, ``lens``, ``before`` (bytes)."""
    cut = turns.groupBy("c", F.floor((F.col("pos") - 1) / size).cast("bigint").alias("j")) \
        .agg(F.sort_array(F.collect_list(F.struct("pos", "dig", "bytes"))).alias("_t")) \
        .select("c", "j", F.col("_t.dig").alias("digs"), F.col("_t.bytes").alias("lens"))
    digest = F.md5(F.concat_ws(",", F.col("j").cast("string"), "digs"))
    lane = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")  # noqa: E731  60 bits
    cut = cut.withColumns({"x1": lane(1), "x2": lane(17)}) \
        .withColumns({"s1": F.col("x1"), "s2": F.col("x2"), "upto": F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, b: a + b)})
    summed = running_sums(cut, "c", ["j"], ["s1", "s2", "upto"])
    text = lambda x: x.cast("decimal(38,0)").cast("string")
    return summed.select(
        "c", "j", "digs", "lens", _key(text(F.col("s1") - F.col("x1")), text(F.col("s2") - F.col("x2"))).alias("above"),
        _key(text(F.col("s1")), text(F.col("s2"))).alias("name"),
        (F.col("upto") - F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("before"), "upto")


def _ends_chunks(batches):
    """Rows (key, id) in order to (key, first id, ids joined by commas)."""
    import pyarrow as pa
    out = pa.schema([("key", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
    key, ids = None, []

    def flush():
        return pa.RecordBatch.from_pydict({"key": [key], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=out)

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != key or len(ids) >= CHUNK_IDS):
                yield flush()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield flush()


def _ends_digests(batches):
    """Chunks in order of (key, first id) to (key, SHA-256 of all its ids); one chunk is held at a time."""
    import pyarrow as pa
    out = pa.schema([("key", pa.string()), ("sha", pa.string())])
    key, digest = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "sha": [s for _, s in done]}, schema=out)
    if digest:
        yield pa.RecordBatch.from_pydict({"key": [key], "sha": [digest.hexdigest()]}, schema=out)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``key``, ``sha``: the SHA-256 of the ascending ids of each key; a key of any size is joined to texts by many tasks."""
    n = shuffle_partitions(ends.sparkSession)
    chunks = ends.select("key", "c").repartitionByRange(n, "key", "c").sortWithinPartitions("key", "c") \
        .mapInArrow(_ends_chunks, "key string, first bigint, ids string")
    return chunks.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(_ends_digests, "key string, sha string")


def prefix_trie(ids: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix of the conversations ``turns`` (``c``, ``pos`` from 1, ``dig``, ``bytes``); ``ids`` (``c``) has all of them.

    The root (depth 0) is there if there is any conversation.  Columns:
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    root = hashlib.md5(b"0,0").hexdigest()
    cut = materialize(blocks(turns, block), "blocks")
    # names of the prefixes that end inside the block; the last of a full block is the block's own
    keys = F.transform(F.sequence(F.lit(1), F.size("digs")), lambda i: F.when(i == block, F.col("name")).otherwise(
        _key(F.col("above"), F.slice("digs", F.lit(1), i))))
    befores = F.transform(F.sequence(F.lit(1), F.size("digs")), lambda i: F.col("before") + F.aggregate(
        F.slice("lens", F.lit(1), i - 1), F.lit(0).cast("bigint"), lambda a, b: a + b))

    # conversations by successive block names
    grouped = materialize(cut.groupBy("above", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("conv"), F.first("j").alias("j"), F.first("digs").alias("digs"),
        F.first("lens").alias("lens"), F.first("before").alias("before")), "block-nodes")
    diverging = materialize(grouped.groupBy("above").agg(F.count(F.lit(1)).alias("_ways")).where("_ways > 1")
                            .select(F.col("above").alias("_above")), "diverging")
    opened = grouped.join(diverging, F.col("above") == F.col("_above"), "left").withColumns({"keys": keys, "befores": befores})
    turn = F.explode(F.transform(F.sequence(F.lit(1), F.size("digs")), lambda i: F.struct(
        (F.col("j") * block + i).alias("depth"), F.element_at("keys", i).alias("key"),
        F.when(i == 1, F.col("above")).otherwise(F.element_at("keys", F.greatest(i - 1, F.lit(1)))).alias("up"),
        F.element_at("befores", i).alias("before"))))
    nodes = opened.select("n", "conv", F.col("_above").isNotNull().alias("split"), turn.alias("t")).select("n", "conv", "split", "t.*")
    nodes = materialize(nodes, "turn-nodes")
    same = nodes.where("split").groupBy("key").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.first("depth").alias("depth"),
                                                   F.first("up").alias("up"), F.first("before").alias("before"))
    top = ids.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("conv")).where("n > 0") \
        .select("n", "conv", F.lit(0).cast("bigint").alias("depth"), F.lit(root).alias("key"), F.lit(None).cast("string").alias("up"),
                F.lit(0).cast("bigint").alias("before"))
    nodes = materialize(nodes.where("NOT split").drop("split").unionByName(same).unionByName(top), "nodes")
    kids = materialize(nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("_up")).agg(F.count(F.lit(1)).alias("n_children")), "children")

    # of every conversation: bytes above the part of its path that it owns, whether it owns a leaf, and the node where it ends
    paths = cut.withColumn("end", F.element_at(keys, -1)).groupBy("c").agg(F.max("upto").alias("total"), F.max_by("end", "j").alias("end"))
    owned = nodes.groupBy(F.col("conv").alias("_o")).agg(F.min_by("before", "depth").alias("above_own"))
    leaves = nodes.join(kids, F.col("key") == F.col("_up"), "left_anti").select(F.col("conv").alias("_l"))
    members = materialize(
        ids.join(paths, "c", "left").join(owned, F.col("c") == F.col("_o"), "left").join(leaves, F.col("c") == F.col("_l"), "left")
        .select("c", F.coalesce("end", F.lit(root)).alias("key"), F.col("_l").isNotNull().cast("bigint").alias("leaf"),
                F.coalesce("above_own", "total", F.lit(0)).alias("saves")), "members")

    # sums over members by block, then by turn
    shared = F.size(F.filter(F.col("befores"), lambda b: b < F.col("saves")))
    by_block = cut.join(members.select("c", "leaf", "saves"), "c").withColumn("befores", befores) \
        .groupBy("above", "name", shared.alias("shared")).agg(
            F.sum("leaf").alias("leaf"), F.count(F.lit(1)).alias("m"), F.sum("saves").alias("saves"),
            F.first("digs").alias("digs"), F.first("lens").alias("lens"), F.first("before").alias("before"))
    sums = by_block.withColumns({"keys": keys, "befores": befores}).select("leaf", "m", "saves", "shared", F.posexplode(F.arrays_zip("keys", "befores"))) \
        .groupBy(F.col("col.keys").alias("_k")).agg(
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.when(F.col("pos") < F.col("shared"), F.col("saves") - F.col("m") * F.col("col.befores")).otherwise(F.lit(0))).alias("saved_tokens"))
    top = members.agg(F.sum("leaf").alias("n_leaves"), F.sum("saves").alias("saved_tokens")).select(F.lit(root).alias("_k"), "n_leaves", "saved_tokens")
    sums = materialize(sums.unionByName(top), "sums")
    ends = materialize(ends_digests(members), "ends")

    parents = nodes.select(F.col("key").alias("_p"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(parents, F.col("up") == F.col("_p"), "left").join(kids, F.col("key") == F.col("_up"), "left") \
        .join(sums, F.col("key") == F.col("_k")).join(ends.withColumnRenamed("key", "_e"), F.col("key") == F.col("_e"), "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
                      F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("sha", F.lit(_EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", block: int = BLOCK, rebuild: bool = True) -> DataFrame:
    """The trie of the (rebuilt) conversations.

    A null role or text is the empty text.  Turns are in order of their number,
    null first; rows that share a number (also repeated rows: each is a turn)
    are in order of their digest.  Rows without a conversation id belong to no
    conversation and are left out.  Texts of any length count by digest and
    byte length.  Other columns are not read.  An empty table gives an empty
    result.
    """
    turns = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    if rebuild:
        return prefix_trie(*rebuilt(turns), block)
    turns = materialize(turns, "turns")
    return prefix_trie(turns.select("c").distinct(), turns, block)


SQL = """
WITH t AS (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig,
  strlen(coalesce(text, '')) AS len, turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, dig, len, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dig) AS pos FROM t),
i AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT i.c, 0 AS own, pos, dig, len FROM i JOIN n ON n.c = i.base WHERE pos <= h UNION ALL SELECT i.c, 1, pos, dig, len FROM i JOIN n ON n.c = i.c WHERE pos > h),
p AS (SELECT i.c, coalesce(q.digs, []) AS digs, coalesce(q.lens, []) AS lens FROM i LEFT JOIN
  (SELECT c, list(dig ORDER BY own, pos) AS digs, list(len ORDER BY own, pos) AS lens FROM r GROUP BY c) q ON q.c = i.c),
m AS (SELECT c, depth, md5(array_to_string(digs[1:depth], ',')) AS k, CASE WHEN depth > 0 THEN md5(array_to_string(digs[1:depth - 1], ',')) END AS up,
  digs[1:depth] AS path, coalesce(lens[depth], 0) AS len, depth = len(digs) AS ends FROM (SELECT *, unnest(range(0, len(digs) + 1)) AS depth FROM p)),
v AS MATERIALIZED (SELECT k, depth, any_value(up) AS up, any_value(path) AS path, min(c) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
  sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM m GROUP BY k, depth),
ch AS (SELECT up AS k, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT md5(array_to_string(path[1:d], ',')) AS k, sum((n_convs - 1) * len)::BIGINT AS saved_tokens, count(*) FILTER (ch IS NULL) AS n_leaves
  FROM (SELECT v.path, v.n_convs, v.len, ch.k AS ch, unnest(range(0, v.depth + 1)) AS d FROM v LEFT JOIN ch ON ch.k = v.k) GROUP BY 1)
SELECT v.conv_id, v.depth, w.conv_id AS parent_conv_id, v.n_convs, coalesce(ch.n_children, 0) AS n_children, a.n_leaves, a.saved_tokens, v.ends_sha256
FROM v LEFT JOIN v w ON w.k = v.up LEFT JOIN ch ON ch.k = v.k JOIN a ON a.k = v.k"""


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
