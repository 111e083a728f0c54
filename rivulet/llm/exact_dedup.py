"""Exact dedup by content-defined chunk recipes.

A text (white-space runs made one space) is cut where its content says so: at
the first space after at least ``MIN_CHUNK`` characters that stands between
chosen letters, at ``MAX_CHUNK`` characters at the latest.  Every distinct
chunk gets an identifier; the dictionary of distinct chunk *texts* proves that
no two of them share one.  A document then is its ordered list of identifiers,
about 8 bytes for each kilobyte, and equal lists are equal texts.  Only chunks
are moved for the proof, each distinct one once per map task; whole documents
never are.

Everything is DataFrame code.  Copies are counted by a partial aggregate and
joined back by a join that adaptive execution can split, so a third of all
rows being one text costs no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import SPACE, first_of_each, table, text_of, told_apart
from rivulet.session import materialize

MIN_CHUNK, MAX_CHUNK = 256, 8192
# a cut follows a word that ends in one of these letter pairs, before one that starts with one of these letters;
# it is rarer than MIN_CHUNK, so that texts which differ in front soon have the same cuts again
CUT = r"(?<=[aeo][nrs]\x20)(?=[bcfghpqv])"
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{CUT}|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    """Every run of white space as one space; texts without such runs pass untouched."""
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, f"{SPACE}+", " ")).otherwise(text)


# Ways to name a chunk, from the shortest on; the last is the chunk itself, which is always right.
IDENTIFIERS = (
    lambda c: F.xxhash64(c),
    lambda c: F.concat(F.xxhash64(c).cast("string"), F.lit("/"), F.xxhash64(F.lit(1), c).cast("string")),
    lambda c: c,
)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(normalised(text), F.lit(CHUNK), F.lit(0))


def verified_identifier(texts: DataFrame, identifiers=IDENTIFIERS):
    """The first of ``identifiers`` that gives every distinct chunk text its own value."""
    for make in identifiers[:-1]:
        distinct = texts.select(F.explode(chunks(F.col("_t"))).alias("_c")).distinct()
        shared = distinct.groupBy(make(F.col("_c")).alias("_i")).count().where("count > 1")
        if shared.isEmpty():
            return make
    return identifiers[-1]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                identifiers=IDENTIFIERS) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_chunks``.

    Texts are equal when identical after white-space runs are made one space;
    the smallest id of a group stays.  A null text counts as empty; empty texts
    are a group like any other.  A null id never is the smallest (a group of
    null ids only has a null ``keep_id`` and ``kept`` true).  Rows repeated
    under one id are equal and get the same decision.  A text of any length is
    cut into chunks whole.  Other columns of ``docs`` are not read.  An empty
    table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    make = verified_identifier(base.select("_t"), identifiers)
    # a hundredth of the texts' size, written once for the count and the join
    recipes = materialize(base.select(
        "_id", F.transform(chunks(F.col("_t")), make).alias("_recipe"),
        F.sha2(normalised(F.col("_t")).cast("binary"), 256).alias("text_sha256")), "recipes")
    groups = recipes.groupBy("_recipe").agg(F.min("_id").alias("keep_id"),
                                            F.count(F.lit(1)).alias("group_size"))
    out = recipes.join(groups, "_recipe")
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size",
                      F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
                      F.size("_recipe").cast("bigint").alias("n_chunks"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   identifiers=IDENTIFIERS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: exactly one of each group of equal texts.

    It is the one with the smallest id; a null id only stays where no row of
    the group has one.  Of rows that repeat the smallest id one stays, by a
    written row number.  Null texts are equal to empty ones.  Texts of any
    length are compared whole.  An empty table gives an empty result.
    """
    rows, key = told_apart(docs, id_col)
    base = rows.select(F.col(key).alias("_key"), F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    make = verified_identifier(base.select("_t"), identifiers)
    recipes = materialize(base.select("_key", "_id", F.transform(chunks(F.col("_t")), make).alias("_recipe")), "recipes")
    gone = recipes.join(first_of_each(recipes, "_recipe"), "_recipe").where("_key != _stays").select(F.col("_key").alias("_gone"))
    kept = rows.join(gone, rows[key] == gone["_gone"], "left_anti")
    return kept if key == id_col else kept.drop(key)


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")
