"""Configuration checks that run before any job (V-1 … V-3)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.functions.coerce import as_column

# Allowed alias characters and the replacement for anything else.
ALIAS_OK = re.compile(r"^[a-zA-Z0-9_-]+$")
ALIAS_BAD = r"[^a-zA-Z0-9_-]+"


def require(config: dict, *keys: str) -> None:
    """Raise ``ValueError`` naming every required key that is missing or empty."""
    missing = [k for k in keys if config.get(k) in (None, "", [], {})]
    if missing:
        raise ValueError(f"missing required config: {', '.join(missing)}")


def valid_alias(alias: str) -> bool:
    return bool(ALIAS_OK.match(alias or ""))


def alias_from_name(name: str) -> str:
    """Alias made from a step name: lower-cased, other characters runs → ``_``."""
    return re.sub(ALIAS_BAD, "_", name.lower())


def alias_column(name) -> Column:
    """``alias_from_name`` as a column expression."""
    return F.regexp_replace(F.lower(as_column(name)), ALIAS_BAD, "_")
