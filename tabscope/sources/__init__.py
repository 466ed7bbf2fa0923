"""Reading and writing tables."""

from tabscope.sources.readers import load
from tabscope.sources.writers import (
    capped_export,
    load_model,
    preview,
    sample_rows,
    save_model,
    schema_summary,
    write_csv,
    write_report,
)

__all__ = [
    "capped_export",
    "load",
    "load_model",
    "preview",
    "sample_rows",
    "save_model",
    "schema_summary",
    "write_csv",
    "write_report",
]
