"""A tiny versioned state table (one row per variable) on shared storage.

Used for high-water marks and persisted flow variables.  Each save appends a
new version ``v`` (a Parquet partition); readers take the highest version, so
a job that dies before its commit leaves the previous state readable.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "name string, value string, v int"
_VERSION = re.compile(r"/v=(\d+)/")


def _plain(value):
    """A value that JSON can hold; exact text for what it cannot."""
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value) if isinstance(value, Decimal) else value


class StateTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _all(self) -> DataFrame | None:
        # a missing table is the normal first-run case: keep it out of the error log
        log = PySparkLogger.getLogger("DataFrameQueryContextLogger")
        level = log.level
        log.setLevel(50)  # CRITICAL
        try:
            return self.spark.read.schema(_SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # unreadable state is not a first run
                raise
            return None
        finally:
            log.setLevel(level)

    def as_frame(self) -> DataFrame:
        """Latest version as a frame ``(name, value)`` with JSON-encoded values."""
        v = self.version()
        if not v:
            return self.spark.createDataFrame([], "name string, value string")
        return self.spark.read.schema("name string, value string").parquet(f"{self.path}/v={v}")

    def version(self) -> int:
        """Highest committed version, from the file listing (no Spark job)."""
        df = self._all()
        if df is None:
            return 0
        found = [int(m.group(1)) for f in df.inputFiles() for m in [_VERSION.search(f)] if m]
        return max(found, default=0)

    def _read_version(self, v: int) -> dict:
        if not v:
            return {}
        rows = self.spark.read.schema("name string, value string").parquet(f"{self.path}/v={v}").collect()
        return {r["name"]: json.loads(r["value"]) for r in rows}

    def read(self) -> dict:
        """All variables of the latest version (one row per variable).

        Decimals, dates and timestamps come back as their text.
        """
        return self._read_version(self.version())

    def get(self, name: str, default=None):
        return self.read().get(name, default)

    def save(self, values: dict, dry_run: bool = False) -> bool:
        """Merge ``values`` into the state; no write when nothing changed or on a dry run."""
        values = {k: _plain(v) for k, v in values.items()}
        version = self.version()
        current = self._read_version(version)
        merged = {**current, **values}
        if dry_run or merged == current:
            return False
        nxt = version + 1
        rows = [(k, json.dumps(v), nxt) for k, v in sorted(merged.items())]
        (self.spark.createDataFrame(rows, _SCHEMA).coalesce(1)
            .write.mode("append").partitionBy("v").parquet(self.path))
        return True
