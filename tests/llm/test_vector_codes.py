import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import vector_codes as V
from tests.llm.helpers import CLASHING

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """(id, label) -> code, error in plain loops over the rows that are kept."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    w = dim // parts
    whole = [[min(max(math.floor(float(np.float32(x)) * 4096), -V.LARGEST), V.LARGEST) for x in v] + [0] * (dim - len(v)) for _, v, _ in kept]
    first = {}
    for (i, _, _), x in zip(kept, whole):
        first[i] = min(first.get(i, x), x)
    starts = [first[i] for i in sorted(first, key=lambda i: (i is None, i))[:entries]]
    books = [[x[j * w:(j + 1) * w] for x in starts] for j in range(parts)]

    def nearest(j, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[j]))

    for _ in range(rounds):
        for j in range(parts):
            groups = {}
            for x in whole:
                y = x[j * w:(j + 1) * w]
                groups.setdefault(nearest(j, y)[1], []).append(y)
            books[j] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[j])]
    out = []
    for (i, _, lab), x in zip(kept, whole):
        found = [nearest(j, x[j * w:(j + 1) * w]) for j in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    text = ",".join(str(c) for book in books for e in book for c in e)
    return [(i, code, err, sum(e for _, other, _, e in out if other == lab), hashlib.sha256(text.encode()).hexdigest())
            for i, lab, code, err in out]


def messy_vectors(n=120, dim=16, seed=3):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(7)]
    rows = []
    for i in range(n):
        v = [x + rnd.gauss(0, 0.05) for x in rnd.choice(centres)]
        rows.append((i, v, rnd.choice([0, 1, 1, 1, None])))
    rows += [(200, None, 1), (201, [None] * dim, 1), (202, [float("nan")] + [0.0] * (dim - 1), 0), (203, [float("inf")] * dim, 0),
             (204, [0.0] * dim, None), (205, [-0.0] * dim, None), (206, [3.0e38] * dim, 2), (207, [-3.0e38] * dim, 2),
             (4, rows[4][1], rows[4][2]), (4, rows[9][1], 1), (None, rows[3][1], 1), (None, rows[8][1], None), (208, rows[4][1], 9)]
    return rows


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in (*CLASHING, "_l", "_v", "_none", "error", "code")})
    out = V.code_report(df)
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_against_brute_force(spark):
    rows = messy_vectors()
    assert got(spark, rows) == sorted(brute(rows), key=repr)


def test_lengths_that_differ_go_on_with_zeros(spark):
    rows = [(i, [float(i % 5)] * (i % 13), i % 2) for i in range(40)]
    assert got(spark, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("rows", [[(3, [0.5] * 8, 1)], [(3, [0.5] * 8, 1)] * 5, [(None, [0.1] * 8, None)], [(1, [], 0), (2, [], 0)]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == sorted(brute(rows), key=repr)


def test_empty_table_and_nothing_kept(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 0), (2, [float("nan")] * 8, 0)]) == []


@pytest.mark.parametrize("k", [1, 2, 16, 200])
def test_search_is_exact_and_skips_entries(k):
    rng = np.random.default_rng(k)
    entries = rng.integers(-50, 50, (k, 4))
    entries[k // 2] = entries[0]  # equal entries: the lower index
    x = np.concatenate([rng.integers(-50, 50, (500, 4)), entries])
    finder = V.Orchard(entries)
    code, d = finder.search(x)
    every = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    if k == 200:
        assert finder.measured < 0.5 * every.size


def test_more_entries_than_rows_and_other_options(spark):
    rows = [(i, [i * 0.25, -i * 0.5, 1.0, 2.0], 0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    codes, books = V.encode(df, parts=2, entries=256, rounds=2)
    assert books.shape == (2, 30, 2) and {r.error for r in codes.collect()} == {0}
    with pytest.raises(ValueError):
        V.encode(df, entries=257)


def test_no_vector_is_gathered(spark):
    """Only sums per entry leave the tasks."""
    books = np.zeros((2, 3, 2), dtype=np.int64)
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"v": [[1, 2, 3, 4]] * 1000}) for _ in range(50)]
    out = list(V._sums(books, 4)(iter(batches)))
    assert sum(b.num_rows for b in out) == 2 * 1 * 2


def test_sql_over_messy_rows(spark):
    rows = [r for r in messy_vectors() if r[0] is not None and r[0] < 203 and r[0] != 4]
    con = duckdb.connect()
    con.register("t", spark.createDataFrame(rows, SCHEMA).toArrow())
    con.execute("CREATE VIEW embeddings AS SELECT * FROM t")
    want = con.execute("SELECT vec_id, code, error, label_error, codebooks_sha256 FROM (" + V.SQL + ")").fetchall()
    assert sorted(want, key=repr) == got(spark, rows)
