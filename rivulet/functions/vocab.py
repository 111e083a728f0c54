"""Expression vocabulary of the flow language as Spark columns (F-1 … F-23).

Users write Spark SQL expressions or ``Column`` objects; these helpers cover
the functions whose meaning differs from a Spark built-in of the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.coerce import as_column, intval, num, truthy_in

__all__ = [
    "add", "sub", "mul", "div", "mod", "concat_text", "isset", "identical", "run_time", "count_of",
    "from_json_or_pass", "duration_text", "round_half_up", "date_text",
    "object_vars", "strtotime", "intval", "matches", "ternary", "path_get",
    "PHP_DATE_LETTERS", "get_var",
]


def _pair(a, b, to):
    return num(a, to), num(b, to)


def add(a, b, to: str = "double") -> Column:
    """Sum of two numbers given as numbers or text, as a double (``to='bigint'``: whole
    numbers); NULL where a text is not a number or the result does not fit."""
    return F.try_add(*_pair(a, b, to))


def sub(a, b, to: str = "double") -> Column:
    return F.try_subtract(*_pair(a, b, to))


def mul(a, b, to: str = "double") -> Column:
    return F.try_multiply(*_pair(a, b, to))


def div(a, b) -> Column:
    x, y = _pair(a, b, "double")
    return F.try_divide(x, y)


def _whole(c) -> Column:
    """Whole part of a number given as a number or text (``'7.9'`` → 7)."""
    col = as_column(c)
    return F.coalesce(col.try_cast("bigint"), num(col, "decimal(38,9)").try_cast("bigint"), num(col).try_cast("bigint"))


def mod(a, b) -> Column:
    """Remainder of the whole parts; the sign follows the dividend."""
    return F.try_mod(_whole(a), _whole(b))


def concat_text(*cols) -> Column:
    return F.concat(*[as_column(c).cast("string") for c in cols])


def matches(c, regex: str) -> Column:
    return as_column(c).cast("string").rlike(regex)


def ternary(cond, a, b, df: DataFrame | None = None) -> Column:
    """``cond ? a : b``.  Given the frame ``df`` the condition belongs to, a condition
    of any type counts by its truth value; without it, it is a boolean."""
    c = as_column(cond) if df is None else truthy_in(df, cond)
    return F.when(c, as_column(a)).otherwise(as_column(b))


def path_get(c, *path) -> Column:
    """``a.b[0]["k"]`` style access; missing parts give NULL, never an error."""
    out = as_column(c)
    for p in path:
        if isinstance(p, int):
            out = F.try_element_at(out, F.lit(p + 1 if p >= 0 else p))
        else:
            out = out.getField(p)
    return out


def identical(a, b) -> Column:
    """``===``: same value, NULL-safe (types are fixed per column in Spark,
    so a type mismatch is an analysis error rather than ``false``)."""
    return as_column(a).eqNullSafe(as_column(b))


def run_time() -> Column:
    """``time()`` bound once when the flow is built, so every row and every
    retry of a task sees the same value."""
    import time
    return F.lit(int(time.time())).cast("bigint")


def isset(c) -> Column:
    return as_column(c).isNotNull()


def count_of(c, kind: str = "array") -> Column:
    """Number of elements of an array (or keys of a map)."""
    col = as_column(c)
    if kind == "map":
        return F.size(F.map_keys(col))
    return F.when(col.isNotNull(), F.size(col))


def from_json_or_pass(c, schema: str, df: DataFrame | None = None) -> Column:
    """``fromJSON``: a text parsed by ``schema``.  Given the frame ``df`` the column
    belongs to, a column of another type passes through unchanged."""
    col = as_column(c)
    if df is not None and not isinstance(df.select(col.alias("_c")).schema["_c"].dataType, T.StringType):
        return col
    return F.from_json(col.cast("string"), schema)


def get_var(path: str, *roots) -> Column:
    """``get_var``: the value at a dotted path in the first of the given structs or
    maps (columns or names, most specific first) that has a value there, else NULL."""
    found = [path_get(r, *path.split(".")) for r in roots]
    return F.coalesce(*found) if found else F.lit(None)


def duration_text(secs) -> Column:
    """Seconds as 'H hours M mins S secs' (own wording; zero parts omitted)."""
    s = num(secs, "bigint")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60

    def part(v, one, many):
        return F.when(v > 0, F.concat(v.cast("string"), F.when(v == 1, F.lit(one)).otherwise(F.lit(many))))

    txt = F.concat_ws(" ", part(h, " hour", " hours"), part(m, " min", " mins"), part(r, " sec", " secs"))
    return F.when(s.isNull(), F.lit(None)).when(s == 0, F.lit("0 secs")).otherwise(txt)


def round_half_up(c, scale: int = 0) -> Column:
    return F.round(num(c, "double"), scale)


# PHP date() format letters and their Spark datetime pattern equivalents.
PHP_DATE_LETTERS = {
    "d": "dd", "D": "EEE", "j": "d", "l": "EEEE",
    "F": "MMMM", "m": "MM", "M": "MMM", "n": "M",
    "Y": "yyyy", "y": "yy",
    "a": "a", "A": "a", "g": "h", "G": "H", "h": "hh", "H": "HH",
    "i": "mm", "s": "ss", "v": "SSS", "u": "SSSSSS",
    "e": "VV", "T": "z", "P": "XXX", "O": "XX",
}


def _offset(ts: Column) -> Column:
    """Seconds that the session's zone is ahead of UTC at ``ts``."""
    text = F.date_format(ts, "xx")
    secs = F.substring(text, 2, 2).cast("int") * 3600 + F.substring(text, 4, 2).cast("int") * 60
    return F.when(F.substring(text, 1, 1) == "-", -secs).otherwise(secs)


def _letter(ch: str, ts: Column) -> Column:
    """One format letter over a timestamp; letters without a meaning stand for themselves."""
    day = F.dayofmonth(ts)
    own = {
        "N": lambda: (F.weekday(ts) + 1).cast("string"),
        "w": lambda: ((F.weekday(ts) + 1) % 7).cast("string"),
        "z": lambda: (F.dayofyear(ts) - 1).cast("string"),
        "t": lambda: F.dayofmonth(F.last_day(ts.cast("date"))).cast("string"),
        "W": lambda: F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
        "o": lambda: F.extract(F.lit("YEAROFWEEK"), ts).cast("string"),
        "L": lambda: F.when(F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31))) == 366, F.lit("1")).otherwise(F.lit("0")),
        "U": lambda: F.unix_seconds(ts).cast("string"),
        "Z": lambda: _offset(ts).cast("string"),
        # summer time: further ahead than in the middle of one of the half-years
        "I": lambda: (_offset(ts) > F.least(*[_offset(F.make_timestamp(F.year(ts), F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
                                             for m in (1, 7)])).cast("int").cast("string"),
        # thousandths of the day at UTC+1
        "B": lambda: F.lpad(F.floor(F.pmod(F.unix_seconds(ts) + 3600, F.lit(86400)) * 10 / 864).cast("string"), 3, "0"),
        "S": lambda: F.when((day % 10 == 1) & (day != 11), F.lit("st")).when((day % 10 == 2) & (day != 12), F.lit("nd"))
                      .when((day % 10 == 3) & (day != 13), F.lit("rd")).otherwise(F.lit("th")),
        "a": lambda: F.lower(F.date_format(ts, "a")),
        "c": lambda: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "r": lambda: F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss XX"),
    }
    if ch in own:
        return own[ch]()
    return F.date_format(ts, PHP_DATE_LETTERS[ch]) if ch in PHP_DATE_LETTERS else F.lit(ch)


def date_text(epoch_secs, fmt: str = "Y-m-d H:i:s") -> Column:
    """``date(fmt, ts)`` over epoch seconds, in the session time zone; a backslash keeps the next character."""
    ts = F.timestamp_seconds(num(epoch_secs, "bigint"))
    parts, i = [], 0
    while i < len(fmt):
        if fmt[i] == "\\" and i + 1 < len(fmt):
            parts.append(F.lit(fmt[i + 1]))
            i += 2
            continue
        parts.append(_letter(fmt[i], ts))
        i += 1
    return F.when(ts.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def object_vars(c) -> Column:
    """Struct → map<string,string> of its fields, NULL ones included."""
    return F.from_json(F.to_json(as_column(c), {"ignoreNullFields": "false"}), "map<string,string>")


# Absolute date texts besides ISO 8601, most specific first.
DATE_FORMATS = (
    "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm:ss z", "d MMMM yyyy HH:mm:ss", "d MMMM yyyy HH:mm", "d MMMM yyyy",
    "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy", "dd-MM-yyyy",
    "yyyyMMdd'T'HHmmss",
)


# What a text must look like for a format's letters to take it: wider than the format, never narrower.
_SHAPES = {"yyyy": r"[+-]?\d{4,}", "MMMM": r"\p{L}{3,}", "MMM": r"\p{L}{3,4}", "MM": r"\d{2}", "dd": r"\d{2}", "d": r"\d+", "HH": r"\d{2}",
           "mm": r"\d{2}", "ss": r"\d{2}", "XX": r"(?:Z|[+-]\d{4})", "z": ".+"}


def date_shape(fmt: str) -> str:
    """A regular expression that every text matches which ``fmt``, one of ``DATE_FORMATS``, can parse."""
    out = []
    for m in re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|(.)", fmt):
        quoted, letters, _, plain = m.groups()
        out.append(_SHAPES[letters] if letters else re.escape(quoted or plain))
    return "(?is)^" + "".join(out) + "$"


def strtotime(c) -> Column:
    """Absolute date/time text → epoch seconds (relative phrases give NULL).

    ``@123`` is epoch seconds; else ISO 8601, eight digits and ``DATE_FORMATS``, in the
    session time zone unless the text names one; a weekday in front is passed over.
    A format is tried only on texts of its shape: a parse that fails costs far more.
    """
    s = F.regexp_replace(F.trim(as_column(c).cast("string")), r"^[A-Za-z]{3,9},\s*", "")
    at = F.when(s.rlike(r"^@-?\d+$"), F.timestamp_seconds(F.substring(s, 2, 30).try_cast("bigint")))
    compact = s.rlike(r"^\d{8}$")
    return F.unix_timestamp(F.coalesce(at, F.when(compact, F.try_to_timestamp(s, F.lit("yyyyMMdd"))),
                                       F.when(~compact, F.try_to_timestamp(s)),
                                       *[F.when(s.rlike(date_shape(f)), F.try_to_timestamp(s, F.lit(f))) for f in DATE_FORMATS]))


# ---- unknown JSON shapes: the same functions over a variant (parse_json) ----

def _variant(c) -> Column:
    col = as_column(c)
    return F.try_parse_json(col.cast("string"))


def json_get(c, path: str = "$", type_: str = "variant") -> Column:
    """Value at a JSON path of a JSON text (``$.a[4].id``); NULL when absent or of another type."""
    return F.try_variant_get(_variant(c), path, type_)


def json_isset(c, path: str = "$") -> Column:
    """``isset``: the path exists and its value is not JSON null."""
    v = F.try_variant_get(_variant(c), path, "variant")
    return v.isNotNull() & ~F.is_variant_null(v)


def json_count(c, path: str = "$") -> Column:
    """``count``: elements of an array or keys of an object at the path, else NULL."""
    v = F.try_variant_get(_variant(c), path, "variant")
    return F.coalesce(F.array_size(F.try_variant_get(v, "$", "array<variant>")),
                      F.size(F.try_variant_get(v, "$", "map<string,variant>")))
