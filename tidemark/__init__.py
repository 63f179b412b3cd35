"""tidemark: a PySpark engine for daily market series.

Every public function takes and returns DataFrames (or Columns) and is lazy:
nothing is collected to the driver. Operators accept an optional list of
series key columns (``keys``) so thousands of instruments run side by side,
partitioned by key; with no keys the frame is one series.
"""

from tidemark.session import get_session, checkpoint_dir, materialize  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "materialize"]
