"""Reading and writing tables."""

from flowloom.sources.tables import SCHEMAS, scan, sql, warehouse_scan
from flowloom.sources.sinks import read_partition, scratch_path, shared_folder, write_partitioned

__all__ = [
    "SCHEMAS",
    "read_partition",
    "scan",
    "scratch_path",
    "shared_folder",
    "sql",
    "warehouse_scan",
    "write_partitioned",
]
