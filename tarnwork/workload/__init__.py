"""Every operator as a registered query over the driver tables."""

from tarnwork.workload import features, governance, lakehouse, series, stream  # noqa: F401
from tarnwork.workload.registry import QUERIES, SQL, full_sql

__all__ = ["QUERIES", "SQL", "full_sql"]
