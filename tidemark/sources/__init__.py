"""Scans, readers and writers."""

from tidemark.sources.scan import (  # noqa: F401
    scan_prices, scan_long_index, scan_series, read_table, write_table,
)
from tidemark.sources.snapshot import ingest_snapshot, read_snapshot  # noqa: F401
