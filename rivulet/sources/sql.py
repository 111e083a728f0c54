"""SQL reader, parameter binding, optional fragments, incremental reads (S-7 … S-10)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rivulet.state import StateTable, _plain

_FRAGMENT = re.compile(r"\[\[(.*?)\]\]", re.S)
_PARAM = re.compile(r"(?<![:\w]):([A-Za-z_]\w*)")


def bind_params(args: dict | None) -> dict:
    """Check run parameters: only text and integers may be bound.

    Booleans, floats, lists and other values raise ``TypeError`` (the values
    are bound, never pasted into the SQL text).
    """
    out = {}
    for k, v in (args or {}).items():
        if v is None:
            out[k] = None
            continue
        if isinstance(v, bool) or not isinstance(v, (str, int)):
            raise TypeError(f"parameter {k!r} must be str or int, got {type(v).__name__}")
        out[k] = v
    return out


def optional_fragments(text: str, args: dict | None) -> str:
    """Keep a ``[[ … :name … ]]`` fragment only when every parameter in it is set.

    A parameter counts as unset when missing, None or ``''``; ``0`` is set.
    The parameters stay bound; nothing is pasted.
    """
    args = args or {}

    def repl(m):
        body = m.group(1)
        names = _PARAM.findall(body)
        if all(args.get(n) not in (None, "") for n in names):
            return body
        return ""

    return _FRAGMENT.sub(repl, text)


def sql_read(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None,
             args: dict | None = None) -> DataFrame:
    """Run a SELECT over named frames (S-7 … S-9).

    ``{name}`` in the text refers to a frame in ``tables``; ``:name`` is a
    bound parameter from ``args``; ``[[ … ]]`` fragments drop out when their
    parameters are unset.  When ``tables`` are given the text is formatted,
    so literal braces (JSON in a string literal) are written ``{{`` ``}}``.
    """
    args = bind_params(args)
    text = optional_fragments(text, args)
    used = {n: v for n, v in args.items() if re.search(rf"(?<![:\w]):{n}\b", text)}
    return spark.sql(text, args=used or None, **(tables or {}))


@dataclass
class IncrementalBatch:
    """Rows after the stored mark, plus the step that saves the new mark."""
    df: DataFrame
    state: StateTable
    name: str
    counter: str
    order_key: Column
    previous: object
    dry_run: bool = False
    _obs: Observation | None = field(default=None, repr=False)

    def observed(self) -> DataFrame:
        """The batch with the new mark gathered during the sink's own pass.

        Write this frame to the sink, then call ``commit``; the mark is read
        from the write's metrics, so no second pass over the batch is needed.
        """
        self._obs = Observation(f"mark_{self.name}")
        return self.df.observe(self._obs, F.max_by(F.col(self.counter), self._counted()).alias("mark"),
                               F.count(F.lit(1)).alias("rows"))

    def _counted(self) -> Column:
        """The order of rows that have a counter; the others leave the mark as it is."""
        return F.when(F.col(self.counter).isNotNull(), self.order_key)

    def new_mark(self):
        """Counter value of the last row of the batch; the old mark when empty."""
        if self._obs is not None:
            m = self._obs.get
            return self.previous if m.get("mark") is None else m.get("mark")
        row = self.df.agg(F.max_by(F.col(self.counter), self._counted()).alias("m")).first()
        return self.previous if row["m"] is None else row["m"]

    def commit(self) -> bool:
        """Save the mark; call only after the sink succeeded.  Dry run: no write."""
        return self.state.save({self.name: self.new_mark()}, dry_run=self.dry_run)


def incremental_read(df: DataFrame, counter: str, state: StateTable, name: str | None = None,
                     limit: int | None = None, order_by=None, dry_run: bool = False) -> IncrementalBatch:
    """Rows whose ``counter`` is above the stored mark (S-10).

    The new mark is the counter of the *last* row in ``order_by`` order
    (default: the counter itself), not the maximum.  An empty first mark means
    no lower bound.  The batch also ends at the largest counter there is now,
    so rows that arrive while it runs belong to the next batch, and computing
    it twice gives the same rows.  ``limit`` cuts the batch after that many
    rows (ordered top-k, no global sort) and then takes in every row that ties
    with the last one's counter: the next run starts above it, so a tied row
    left out would never be read.  Rows without a counter belong to every run
    that has no mark yet, besides its limit.  A dry run reads but never saves.  Runs of
    one flow must not overlap.
    """
    name = name or counter
    previous = state.get(name)
    kind = df.schema[counter].dataType
    at = F.col(counter)
    # without a mark there is no lower bound, so rows without a counter are read, too
    uncounted = df.where(at.isNull()) if previous in (None, "") else None
    src = df.where(at.isNotNull()) if previous in (None, "") else df.where(at > F.lit(previous).cast(kind))
    # computed now: Parquet and JDBC answer it from statistics or an index
    ceiling = src.agg(F.max(at).alias("m")).first()["m"]
    if ceiling is not None:
        src = src.where(at <= F.lit(ceiling).cast(kind))
    order = [counter] if order_by is None else ([order_by] if isinstance(order_by, (str, Column)) else list(order_by))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    from rivulet.operators.ordering import order_key
    batch = src
    if limit:
        top = src.orderBy(*cols).limit(limit)
        # one value, computed now so that a retry cuts at the same place
        last = top.agg(F.max_by(at, order_key(cols)).alias("m")).first()["m"]
        if last is not None:
            batch = top.where(at != F.lit(last)).unionByName(src.where(at == F.lit(last)))
    if uncounted is not None:
        batch = batch.unionByName(uncounted)
    return IncrementalBatch(batch, state, name, counter, order_key(cols), previous, dry_run)


@dataclass
class KeysetBatch:
    """The next rows in order of (counter, key), and the step that saves where they end."""
    df: DataFrame
    state: StateTable
    name: str
    end: dict | None
    dry_run: bool = False

    def commit(self) -> bool:
        """Save the end of the batch; call only after the sink succeeded.  Nothing is saved for an empty batch or a dry run."""
        return self.end is not None and self.state.save({self.name: self.end}, dry_run=self.dry_run)


def _after(at: Column, key: Column, mark: dict, kinds) -> Column:
    """Rows behind a mark in the order (counter, NULL first; key)."""
    k = F.lit(mark["key"]).cast(kinds[1])
    if mark["counter"] is None:
        return at.isNotNull() | (key > k)
    c = F.lit(mark["counter"]).cast(kinds[0])
    # the first condition reaches the source as a filter
    return (at >= c) & ((at > c) | (key > k))


def incremental_keyset(df: DataFrame, counter: str, key: str, state: StateTable, limit: int, name: str | None = None,
                       dry_run: bool = False) -> KeysetBatch:
    """The next ``limit`` rows in order of ``counter`` and a unique ``key`` (S-10).

    The mark holds both, so a batch may end among rows that share a counter
    (which a third of all rows may do) and the next one goes on behind it: no
    batch is larger than ``limit`` and each row is read once.  Rows without a
    counter come first.  ``key`` must be unique and not NULL.  The end of the
    batch is found by an ordered top-k of two columns; the rows are then read by
    a range condition.  Rows that arrive behind the mark belong to later
    batches, rows that arrive before it are not seen.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    name = name or f"{counter},{key}"
    mark = state.get(name)
    at, k = F.col(counter), F.col(key)
    kinds = df.schema[counter].dataType, df.schema[key].dataType
    src = df if mark is None else df.where(_after(at, k, mark, kinds))
    last = src.select(at.alias("c"), k.alias("k")).orderBy(F.col("c").asc_nulls_first(), F.col("k")).limit(limit) \
        .agg(F.max(F.struct(F.col("c").isNotNull(), "c", "k")).alias("m")).first()["m"]
    if last is None:
        return KeysetBatch(src.where(F.lit(False)), state, name, None, dry_run)
    end = {"counter": _plain(last["c"]), "key": _plain(last["k"])}
    c, top = F.lit(end["counter"]).cast(kinds[0]), F.lit(end["key"]).cast(kinds[1])
    upto = at.isNull() & (k <= top) if end["counter"] is None else at.isNull() | (at < c) | ((at == c) & (k <= top))
    return KeysetBatch(src.where(upto), state, name, end, dry_run)
