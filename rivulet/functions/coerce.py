"""Loose-typing rules expressed as Spark columns.

Spark runs with ANSI mode on, so mixing strings and numbers raises.  The
flows this library replaces compare and add string fields as numbers, so
numeric use of a string column goes through ``try_cast`` (NULL when the text
is not a number) instead of switching ANSI off.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEMPLATE = re.compile(r"\$\{\{(.*?)\}\}", re.S)


def as_column(c) -> Column:
    """A Column as is; a string is a Spark SQL expression."""
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.expr(c)
    return F.lit(c)


def num(c, to: str = "double") -> Column:
    """Numeric view of a column: NULL where the text is not a number."""
    return as_column(c).try_cast(to)


def truthy(c, dtype: T.DataType | None = None) -> Column:
    """Truth value of a column under the loose rules.

    false, 0, 0.0, '', '0', NULL and empty arrays/maps are false; anything
    else (including every struct) is true.  ``dtype`` is the column's Spark
    type; pass it when known, else strings are assumed.
    """
    c = as_column(c)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(dtype, T.StructType):
        return c.isNotNull()
    s = c.cast("string")
    return F.coalesce((s != "") & (s != "0"), F.lit(False))


def truthy_in(df: DataFrame, c) -> Column:
    """``truthy`` with the type taken from the analysed plan (no job runs)."""
    col = as_column(c)
    dtype = df.select(col.alias("_t")).schema["_t"].dataType
    return truthy(col, dtype)


def natural_key(c, case_insensitive: bool = True) -> Column:
    """Sort key that orders digit runs by value (img2 < img10).

    The text is split into digit and non-digit runs; a digit run becomes its
    length (10 digits, zero-padded) followed by the digits without leading
    zeros, so plain string order of the array equals natural order.
    """
    s = as_column(c).cast("string")
    if case_insensitive:
        s = F.lower(s)
    parts = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), 1)

    def norm(p):
        t = F.ltrim(p, F.lit("0"))
        stripped = F.when(t == "", F.lit("0")).otherwise(t)
        return F.when(p.rlike(r"^\d"),
                      F.concat(F.lpad(F.length(stripped).cast("string"), 10, "0"), stripped)
                      ).otherwise(p)

    return F.transform(parts, norm)


def glob_to_regex(pattern: str) -> str:
    """Shell glob to an anchored Java regex; ``*`` also matches ``/``."""
    out, i = ["^"], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = pattern.find("]", i + 1)
            if j == -1:
                out.append(r"\[")
            else:
                body = pattern[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(ch))
        i += 1
    out.append("$")
    return "".join(out)


def intval(c) -> Column:
    """Leading integer of a text, else 0 (`' 42abc'` → 42, `'x'` → 0).

    More digits than a bigint holds give the nearest bigint.
    """
    digits = F.regexp_substr(F.trim(as_column(c).cast("string")), F.lit(r"^[+-]?\d+"))
    most = F.when(digits.startswith("-"), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)).cast("bigint")
    return F.when(digits.isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce(digits.try_cast("bigint"), most))


_FLAG_MAP = {"i": "i", "m": "m", "s": "s", "x": "x", "u": "u"}


def translate_regex(pattern: str) -> str:
    """A delimited pattern (``/…/i``) to Java regex syntax.

    Delimiters are removed, trailing flags become an inline group, and the
    other spellings of a named group, ``(?P<name>`` and ``(?'name'``, become
    ``(?<name>`` (see ``java_groups`` for names Java does not allow).  Recursion, ``\\K`` and possessive
    forms that Java lacks raise ``ValueError``.
    """
    p = pattern
    if len(p) >= 2 and not p[0].isalnum() and p[0] not in "\\( [":
        delim = p[0]
        closing = {"(": ")", "{": "}", "[": "]", "<": ">"}.get(delim, delim)
        end = p.rfind(closing)
        if end > 0:
            flags = p[end + 1:]
            p = p[1:end]
            bad = [f for f in flags if f not in _FLAG_MAP]
            if bad:
                raise ValueError(f"unsupported regex flag(s): {''.join(bad)}")
            inline = "".join(_FLAG_MAP[f] for f in flags if f != "u")
            if inline:
                p = f"(?{inline})" + p
    p = p.replace("(?P<", "(?<")
    p = re.sub(r"\(\?'([A-Za-z_]\w*)'", r"(?<\1>", p)
    if re.search(r"\(\?R\)|\(\?\d+\)|\\K", p):
        raise ValueError("pattern uses recursion or \\K, which Java regex lacks")
    return p


def named_groups(pattern: str) -> dict[str, int]:
    """Map of named group → capture index for a Java regex (1-based)."""
    names, idx, i, in_class = {}, 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
        elif ch == "[":
            in_class = True
        elif ch == "(":
            if pattern.startswith("(?<", i) and not pattern.startswith(("(?<=", "(?<!"), i):
                idx += 1
                m = re.match(r"\(\?<([A-Za-z_]\w*)>", pattern[i:])
                if m:
                    names[m.group(1)] = idx
            elif not pattern.startswith("(?", i):
                idx += 1
        i += 1
    return names


def java_groups(pattern: str) -> str:
    """The pattern with its named groups as plain ones; references by name become numbers.

    Groups are extracted by index, so any name may be a column's.
    """
    names = named_groups(pattern)
    for name, idx in names.items():
        pattern = pattern.replace(f"(?<{name}>", "(")
        pattern = re.sub(rf"\\k[<'{{]{name}[>'}}]", lambda m, i=idx: f"\\{i}", pattern)
    return pattern


def template(value) -> Column:
    """Field value from a config entry.

    * a Column → used as is;
    * text without ``${{ … }}`` → literal;
    * exactly ``${{ expr }}`` → the typed value of the Spark SQL expression;
    * text mixing literals and ``${{ … }}`` → a string built by ``concat``.

    An expression that yields NULL makes the whole mixed string NULL (the
    original left the raw ``${{ … }}`` text in place).
    """
    if not isinstance(value, str):
        return as_column(value)
    parts = _TEMPLATE.split(value)
    if len(parts) == 1:
        return F.lit(value)
    if len(parts) == 3 and parts[0] == "" and parts[2] == "":
        return F.expr(parts[1].strip())
    cols = []
    for i, piece in enumerate(parts):
        if i % 2 == 0:
            if piece:
                cols.append(F.lit(piece))
        else:
            cols.append(F.expr(piece.strip()).cast("string"))
    return F.concat(*cols)
