"""Readers (S-1 … S-15)."""

from rivulet.sources.csv import read_csv
from rivulet.sources.json import read_json, extract_array, object_values, natural_sort
from rivulet.sources.sql import sql_read, bind_params, optional_fragments, incremental_read, IncrementalBatch
from rivulet.sources.files import (
    list_files, list_constraints, file_count, file_count_by_dir, paths_exist, path_scheme, path_permitted,
)
from rivulet.sources.queue import read_event_queue

__all__ = [
    "read_csv", "read_json", "extract_array", "object_values", "natural_sort",
    "sql_read", "bind_params", "optional_fragments", "incremental_read", "IncrementalBatch",
    "list_files", "list_constraints", "file_count", "file_count_by_dir", "paths_exist",
    "path_scheme", "path_permitted", "read_event_queue",
]
