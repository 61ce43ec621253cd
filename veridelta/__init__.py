"""Value-level comparison of large tables, on Spark."""

from .operators.diff import diff_tables
from .operators.hashdiff import HashDiff
from .operators.joindiff import JoinDiff
from .operators.segment import Segment
from .sources.connect import connect, connect_to_table

__all__ = ["HashDiff", "JoinDiff", "Segment", "connect", "connect_to_table", "diff_tables"]
