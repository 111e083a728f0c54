"""Small tables with everything that can be odd about documents."""

import random

# names that operators use inside
CLASHING = ("_id", "_t", "id", "key", "fp", "size", "score", "_gone", "_mix_id", "_recipe", "stats", "starts", "_b", "kept", "_row",
            "_mix_copy", "_mix_row", "_row_key", "_key", "_stays", "_statistics")


def prose(rnd, n, words=None):
    pool = words or ["the", "of", "and", "der", "und", "la", "que", "et", *(a + b for a in ("stan", "mor", "lif", "kor", "wen")
                                                                         for b in ("ter", "dal", "ing", "os", "eau", "ung"))]
    return " ".join(rnd.choice(pool) for _ in range(n))


def messy_rows(seed=1):
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rnd = random.Random(seed)
    passage = prose(rnd, 70)
    rows, base = [], [prose(rnd, rnd.randint(1, 160)) for _ in range(40)]
    for i, t in enumerate(base):
        rows.append((i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "ü", None])))
    for i in range(40, 70):
        t = rnd.choice(base)
        kind = i % 5
        if kind == 0:
            t = t.replace(" ", " \t\n")
        elif kind == 1:
            t = t + " extra"
        elif kind == 2:
            t = prose(rnd, 30) + " " + passage + " " + prose(rnd, 10)
        elif kind == 3:
            t = "  " + t + "\x1c\x85  x"
        rows.append((i, t, "en", "a"))
    rows += [(70, "", "en", "a"), (71, None, None, None), (72, " \n\t ", "de", "b"), (73, "\U0001f600 ñandú \u0001 | ß", "es", "b"),
             (74, "!!! ??? ...", None, "ü"), (75, prose(rnd, 30000), "en", "a"), (76, "x" * 50000, "en", "b"), (77, "same " * 3000, "en", "b"),
             (78, passage, "en", "ü"), (79, "word", "fr", None), (5, rows[5][1], rows[5][2], rows[5][3]), (70, "", "en", "a")]
    return rows


def messy(spark, rows=None, clash=True):
    from pyspark.sql import functions as F
    rows = messy_rows() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clash else df


def with_null_ids(rows):
    """The rows and two more without an id: one text of its own, one copy of another."""
    return [*rows, (None, "no id at all here", "en", "a"), (None, rows[3][1], "en", "b")]


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
