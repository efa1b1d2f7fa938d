"""Table sources: declared schemas, CSV/parquet loading and the fixture views."""

from .fixtures import fixture_tables
from .tables import load_datasets, save_datasets, scan_counts

__all__ = ["fixture_tables", "load_datasets", "save_datasets", "scan_counts"]
