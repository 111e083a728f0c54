"""SpotSigs document fingerprints.

A spot is a common word (an article, a preposition, a form of "to be" ...); its
signature is the chain of the next content words.  So that lists and headlines
have signatures too, a mark that ends a sentence or a cell and the start of
the text count as common words.  Runs of common words are one spot, and common
words inside a chain are passed over.

Texts are compared by the Jaccard likeness of their signature sets.
``near_pairs`` partitions the sets by their size: only sets whose sizes differ
by less than the threshold can match, so a set meets its own size class and the
next.  There it is looked up by its rarest signatures (enough of them that a
match must share one), and what is left is compared exactly.

Everything is DataFrame code.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import shuffle_partitions, table, text_of
from rivulet.session import materialize

# the commonest function words of four languages
COMMON = (
    "the of and to a in is that for it was on with be as by this are at from "
    "der die und den von zu das sich mit auf des für ist nicht im dem ein eine als "
    "de la que el en y los se del las por un no con su una es para al lo "
    "le et les du une pour est qui dans par pas au sur avec"
).split()
CHAIN = 2
THRESHOLD = 0.8
# characters of words
_L = r"\p{L}\p{N}"
# marks that end a sentence or a cell, also full-width, Arabic, Armenian, Devanagari and Ethiopic ones, and line ends
_MARKS = r".!?;:|\n\u2026\u203C\u2047-\u2049\u3002\uFF01\uFF0E\uFF1A\uFF1B\uFF1F\uFF5C\uFF61\u061B\u061F\u06D4\u0589\u0964\u0965\u1362\u2028\u2029"


def one_of(words) -> str:
    """A pattern for any of the words that looks at each letter once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words) - {""}):
        heads.setdefault(w[0], []).append(w[1:])
    parts = [h + (one_of(tails) if any(tails) else "") for h, tails in heads.items()]
    return f"(?:{'|'.join(parts)}){'?' if '' in words else ''}"


_SPOT = rf"(?:(?:[{_MARKS}]|(?<![{_L}]){one_of(COMMON)}(?![{_L}]))[^{_L}]*+)++"
_MARK = "\x01"
_CHAIN = rf"{_MARK}(?=([{_L}]++(?:[^{_L}]++[{_L}]++){{0,{CHAIN - 1}}}))"
_NO_ID = -(1 << 63)


def spots(text: Column) -> Column:
    """The chains of a text as they stand in it, with what lies between their words."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.translate(F.lower(text), _MARK, " ")), _SPOT, _MARK)
    return F.regexp_extract_all(marked, F.lit(_CHAIN), F.lit(1))


def signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the sorted distinct signature hashes of column ``text``.

    A text without words has itself as its one signature, the empty text none.
    """
    chain = f"_{name}_chain"
    hashed = F.transform(F.col(chain), lambda s: F.xxhash64(F.regexp_replace(s, f"[^{_L}]+", " ")))
    alone = F.when(F.col(text) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.lit(1), F.col(text))))
    return df.withColumn(chain, spots(F.col(text))) \
        .withColumn(name, F.when(F.size(chain) > 0, F.sort_array(F.array_distinct(hashed))).otherwise(alone)).drop(chain)


def fingerprint(sigs: Column) -> Column:
    """A digest of a signature set: its size and a 64-bit hash of its sorted members."""
    return F.concat_ws("-", F.lpad(F.hex(F.size(sigs)), 8, "0"), F.lpad(F.hex(F.xxhash64(sigs)), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    most = F.size(a) + F.size(b) - both
    return F.when(a == b, F.lit(1.0)).otherwise(both / F.greatest(most, F.lit(1)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_t``, ``_next``: each row with the text of the next row by (id, text); the last one's is the first.

    Rows are dealt by ranges of the id, and the first row of a range is also
    put, marked, at the end of the range before.  So texts move once, and no
    task sees more than its range and one row.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("_id"), text_of(text_col).alias("_t"))
    n = 4 * shuffle_partitions(spark)
    cuts = sorted({int(x) for x in base.where(F.col("_id") != _NO_ID).approxQuantile(
        "_id", [k / n for k in range(1, n)], 1 / (4 * n))})  # at most n values, whatever the size of the table

    def up_to(values):
        return F.size(F.filter(F.array(*[F.lit(v).cast("bigint") for v in values]), lambda x: x <= F.col("_id"))) if values else F.lit(0)

    # two steps of about sqrt(n) comparisons
    step = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[::step]
    fine = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in cuts[k:k + step]]) for k in range(0, len(cuts), step)]) if cuts else None
    if cuts:
        c = up_to(coarse)
        inside = F.size(F.filter(F.element_at(fine, F.greatest(c, F.lit(1))), lambda x: x <= F.col("_id")))
        bucket = F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + inside)
    else:
        bucket = F.lit(0)
    base = base.withColumn("_b", bucket.cast("int"))
    firsts = {r["_b"]: r["lo"] for r in base.groupBy("_b").agg(F.min("_id").alias("lo")).collect()}  # one row per range
    if not firsts:
        return base.select("_id", "_t", F.col("_t").alias("_next"))
    order = sorted(firsts)
    before = {b: order[k - 1] for k, b in enumerate(order)}  # the first range's row closes the last range
    ghosts = base.where(F.col("_id").isin(list(firsts.values()))).groupBy("_id", "_b").agg(F.min("_t").alias("_t"))
    back = F.array(*[F.lit(before.get(b, 0)) for b in range(order[-1] + 1)])
    ghosts = ghosts.select("_id", "_t", F.element_at(back, F.col("_b") + 1).alias("_b"), F.lit(1).alias("_g"))
    rows = base.select("_id", "_t", "_b", F.lit(0).alias("_g")).unionByName(ghosts)
    w = Window.partitionBy("_b").orderBy("_g", "_id", "_t")
    return rows.withColumn("_next", F.lead("_t").over(w)).where("_g = 0").select("_id", "_t", "_next")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD):
    """(members, pairs): documents with their class, and the pairs of classes at least ``threshold`` alike.

    ``members`` has one row per row of ``docs``: id and ``rep``, the smallest id
    with the same signature set.  ``pairs`` has ``a`` < ``b`` (representatives)
    and ``likeness``; pairs of texts without any signature are in one class.
    Null texts count as empty.  Rows with a null id are in no class (``rep``
    null) unless an id shares their set.
    """
    base = signatures(docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("_t")), "_t", "_s")
    base = materialize(base.select("_id", "_s"), "spot-sets")
    reps = materialize(base.groupBy("_s").agg(F.min("_id").alias("rep")), "spot-classes")
    members = base.join(reps, "_s").select(F.col("_id").alias(id_col), "rep")
    # the size class of a set: sizes that could match are in the same or in neighbouring classes
    size = F.size("_s")
    sets = reps.where((size > 0) & F.col("rep").isNotNull()).withColumn("_n", size) \
        .withColumn("_c", F.floor(F.log(F.col("_n").cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold)) + 1e-9).cast("int"))
    tokens = sets.select("rep", "_n", "_c", F.explode("_s").alias("_x"))
    df = tokens.groupBy("_x").agg(F.count(F.lit(1)).alias("_df"))
    # a set's rarest signatures: a match shares one of the first n - ceil(threshold * n) + 1
    ranked = tokens.join(df, "_x").groupBy("rep", "_n", "_c").agg(F.sort_array(F.collect_list(F.struct("_df", "_x"))).alias("_r"))
    prefix = ranked.select("rep", "_n", "_c", F.explode(F.slice(
        "_r", F.lit(1), F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9).cast("int") + 1)).alias("_r")).select("rep", "_n", "_c", "_r._x")
    own = prefix.select(F.col("rep").alias("a"), F.col("_n").alias("an"), "_x", F.explode(F.array(F.col("_c"), F.col("_c") + 1)).alias("_k"),
                        F.col("_c").alias("ac"))
    other = prefix.select(F.col("rep").alias("b"), F.col("_n").alias("bn"), "_x", F.col("_c").alias("_k"))
    sizes = (F.least("an", "bn") >= F.greatest("an", "bn") * F.lit(threshold) - 1e-9)
    # of two sets of one size class the smaller id asks; else the smaller class does
    found = own.join(other, ["_x", "_k"]).where(sizes & (F.col("a") != F.col("b")) & ((F.col("ac") < F.col("_k")) | (F.col("a") < F.col("b")))) \
        .select("a", "b").distinct()
    sa = sets.select(F.col("rep").alias("a"), F.col("_s").alias("sa"))
    sb = sets.select(F.col("rep").alias("b"), F.col("_s").alias("sb"))
    pairs = found.join(sa, "a").join(sb, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))) \
        .where(F.col("likeness") >= threshold - 1e-9)
    return members, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``signatures`` (sorted hashes), ``fingerprint``.  A null text counts as empty."""
    out = signatures(docs.select(F.col(id_col), text_of(text_col).alias("_t")), "_t", "signatures")
    return out.select(id_col, "signatures", fingerprint(F.col("signatures")).alias("fingerprint"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited text, and how alike they are.

    The edited text has its last quarter (rounded down, in code points) replaced
    by the first as many of the next text.  Rows are in order of (id, text),
    null ids first; the last row's next is the first.  A null text counts as
    empty.  A single row is its own next.  Other columns of ``docs`` are not
    read.  An empty table gives an empty result.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("_t").cast("bigint"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("_e", F.concat(F.substr("_t", F.lit(1), F.col("n_chars").cast("int") - quarter),
                                          F.substr("_next", F.lit(1), quarter)))
    for text, name in (("_t", "_st"), ("_e", "_se"), ("_next", "_sn")):
        rows = signatures(rows, text, name)
    return rows.select(
        F.when(F.col("_id") != _NO_ID, F.col("_id")).alias(id_col), "n_chars",
        F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("_st")).alias("fingerprint"), fingerprint(F.col("_se")).alias("edited_fingerprint"),
        likeness(F.col("_st"), F.col("_se")).alias("near_edited"),
        likeness(F.col("_st"), F.col("_sn")).alias("near_next"))


def op2_spotsigs(spark, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))
