"""Vector code compression: product codes whose nearest entries are found by Orchard's search.

A vector is cut into equal consecutive parts; each part is replaced by the
number of its nearest entry in that position's codebook.  Everything is whole
numbers (floor(4096 * x)), so results do not depend on the order of rows.

Orchard's search: every entry keeps the list of the other entries of its
codebook, nearest first.  A query starts at one entry and walks its list.  An
entry that is nearer to the query (of equally near ones: that has the lower
index) becomes the current one and its list is walked from the start; visited
entries are marked and not measured again.  The walk ends at the first listed
entry beyond twice the current distance: by the triangle inequality no entry
from there on is nearer, and none as near is left out.  All parts of a batch
walk at once.

Each round is one pass over the written vectors: a task returns one row for
each (part, entry, component), sums are added up by Spark, and the new
codebooks (parts * entries * part length numbers, whatever the number of
vectors) travel to the tasks with the next pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import table
from rivulet.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# larger components are held to this, so that every sum of squares and every sum of a part stays exact in 64 bits
LARGEST = 1 << 26


class Orchard:
    """One codebook with the distance-sorted neighbour lists of its entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # (k, width) whole numbers
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        k = len(entries)
        order = np.argsort(between, axis=1, kind="stable")
        # an entry is not in its own list
        self.near = np.array([[e for e in row if e != i] for i, row in enumerate(order)], dtype=np.int64).reshape(k, max(k - 1, 0))
        self.apart = np.take_along_axis(between, self.near, axis=1)
        self.measured = 0  # distances that searches have computed

    def search(self, x: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` and its squared distance; of equally near ones the lowest index."""
        n, k = len(x), len(self.entries)
        current = np.full(n, start, dtype=np.int64)
        best = ((x - self.entries[start]) ** 2).sum(axis=1)
        self.measured += n
        seen = np.zeros((n, k), dtype=bool)
        seen[:, start] = True
        at = np.zeros(n, dtype=np.int64)  # place in the current entry's list
        walking = np.arange(n if k > 1 else 0)
        while len(walking):
            c, p = current[walking], at[walking]
            inside = p < k - 1
            p = np.minimum(p, k - 2)
            # beyond twice the current distance, in squares
            inside &= self.apart[c, p] <= 4 * best[walking]
            walking, c, p = walking[inside], c[inside], p[inside]
            entry = self.near[c, p]
            at[walking] += 1
            new = ~seen[walking, entry]
            rows, entry = walking[new], entry[new]
            seen[rows, entry] = True
            d = ((x[rows] - self.entries[entry]) ** 2).sum(axis=1)
            self.measured += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (entry < current[rows]))
            rows, entry = rows[better], entry[better]
            current[rows], best[rows], at[rows] = entry, d[better], 0
        return current, best


def _matrix(column, dim: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors go on with zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), dtype=np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def _sums(books: np.ndarray, dim: int):
    parts, entries, width = books.shape

    def run(batches):
        import pyarrow as pa
        finders = [Orchard(b) for b in books]
        total = np.zeros((parts, entries, width), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim).reshape(batch.num_rows, parts, width)
            for j, finder in enumerate(finders):
                code, _ = finder.search(x[:, j])
                np.add.at(total[j], code, x[:, j])
                count[j] += np.bincount(code, minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()),
             pa.array(np.tile(np.arange(width), len(part)), pa.int32()),
             pa.array(np.repeat(count[part, entry], width), pa.int64()), pa.array(total[part, entry].reshape(-1), pa.int64())],
            names=["part", "entry", "at", "n", "s"])

    return run


def _codes(books: np.ndarray, dim: int):
    parts, _, width = books.shape

    def run(batches):
        import pyarrow as pa
        finders = [Orchard(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), dim).reshape(batch.num_rows, parts, width)
            found = [finder.search(x[:, j]) for j, finder in enumerate(finders)]
            code = ["".join(f"{c:02x}" for c in row) for row in np.stack([c for c, _ in found], axis=1).tolist()]
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                names=["_id", "_label", "code", "error"])

    return run


def codebooks(kept: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts, entries, width) after ``rounds`` rounds over ``kept`` (``_id``, ``_v``: whole numbers)."""
    first = kept.groupBy(F.col("_id").isNull().alias("_none"), "_id").agg(F.min("_v").alias("_v")) \
        .orderBy("_none", "_id").limit(entries).collect()
    books = np.zeros((parts, len(first), dim // parts), dtype=np.int64)
    for e, r in enumerate(first):
        books[:, e] = np.array([*r["_v"], *[0] * (dim - len(r["_v"]))], dtype=np.int64).reshape(parts, -1)
    for _ in range(rounds if first else 0):
        # one row for each number of the codebooks
        rows = kept.select("_v").mapInArrow(_sums(books, dim), "part int, entry int, at int, n bigint, s bigint") \
            .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        books = books.copy()  # unused entries stay
        for r in rows:
            books[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """(codes, books): one row per kept vector (id, label, ``code``, ``error``), and the codebooks as an array.

    Vectors that are null or hold a null, NaN or infinite component are left
    out.  Component x becomes floor(``scale`` * x), held within +-2^26.  The
    first codebooks are the parts of the ``entries`` smallest ids (of vectors
    that share an id the smallest; null ids come after all others); ties of
    distance go to the lower index, so repeated rows get equal codes.  A table
    with fewer ids has smaller codebooks.  Vectors shorter than the longest, and
    lengths that ``parts`` does not divide, go on with zeros.  Other columns are
    not read.  An empty table gives an empty result and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(
        F.greatest(F.lit(-1e9), F.least(F.lit(1e9), v.cast("double"))) * F.lit(float(scale))).cast("double"))).cast("int"))
    kept = materialize(vectors.where(usable).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"),
                                                    whole.alias("_v")), "vectors")
    longest = kept.agg(F.max(F.size("_v"))).first()[0] or 0
    dim = -(-longest // parts) * parts
    books = codebooks(kept, dim, parts, entries, rounds)
    out = T.StructType([kept.schema["_id"], kept.schema["_label"], T.StructField("code", T.StringType()),
                        T.StructField("error", T.LongType())])
    codes = kept.select("_id", "_label", "_v").mapInArrow(_codes(books, dim), out)
    return codes.withColumnsRenamed({"_id": id_col, "_label": label_col}), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                **options) -> DataFrame:
    """``encode`` with ``label_error``, the error of all vectors of the row's label (null labels together), and the codebooks' digest."""
    codes, books = encode(vectors, id_col, vector_col, label_col, **options)
    codes = materialize(codes.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), "code", "error"), "codes")
    # written, so that a label of a third of all rows meets a small table or a join that can be split
    errors = materialize(codes.groupBy(F.col("_label").alias("_l")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(errors, codes["_label"].eqNullSafe(errors["_l"])) \
        .select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    near = """SELECT p.rid, p.part, p.x, arg_min(c.e, {{'d': {d}, 'e': c.e}}) AS e, min({d}) AS d
  FROM p JOIN c{i} c ON p.part = c.part GROUP BY p.rid, p.part, p.x"""
    d = "coalesce(list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0)::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(d=d, i=i)})")
        if i < rounds:
            # floor(s / n) without leaving whole numbers
            steps.append(f"""s{i} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM (
  SELECT part, e, k, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT part, e, unnest(x) AS y, unnest(range(len(x))) AS k FROM a{i}) GROUP BY part, e, k) GROUP BY part, e),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(s.c, c.c) AS c FROM c{i} c LEFT JOIN s{i} s ON s.part = c.part AND s.e = c.e)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM v, (SELECT unnest(range(8)) AS part)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x AS c FROM p WHERE rid <= 16),
{", ".join(steps)},
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM c{rounds}),
r AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT v.vec_id, r.code, r.error, (sum(r.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, b.h AS codebooks_sha256
FROM v JOIN r USING (rid), b"""


# for vectors of one length, a multiple of 8
SQL = _sql()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return code_report(table(spark, sf_dir, "embeddings"))
