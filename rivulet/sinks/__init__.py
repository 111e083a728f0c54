"""Writers (K-1 … K-8).  A dry run plans and executes the flow but swaps the
sink for Spark's ``noop`` format, so nothing is written."""

from rivulet.sinks.writers import (
    write, write_json, write_csv, debug_json, write_json_array, copy_dataset,
    concat_skip_headers, copy_files, gzip_files, gunzip_table,
)

__all__ = [
    "write", "write_json", "write_csv", "debug_json", "write_json_array", "copy_dataset",
    "concat_skip_headers", "copy_files", "gzip_files", "gunzip_table",
]
