"""Event-queue processing with Structured Streaming (T-1 … T-6)."""

from rivulet.streaming.queue import (
    capture, drain, last_value_per_key, read_latest, run_available_now, upsert_log, POLICIES,
)

__all__ = ["capture", "drain", "last_value_per_key", "read_latest", "run_available_now", "upsert_log", "POLICIES"]
