"""Incremental ingest with Structured Streaming.

The forecasting pipeline itself is batch (daily snapshots); the only
streaming piece is the landing-file ingest behind the snapshot refresh:
new files in a landing folder are picked up once (the stream's checkpoint
remembers which), appended to the snapshot table, and the stream stops when
everything available has been processed.
"""

from tidemark.streaming.ingest import ingest_stream  # noqa: F401
