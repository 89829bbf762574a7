"""Statistical detection of suspicious table cells, as Spark DataFrame jobs."""

from tablewarden.sources.lake import Lake, lake_from_table, lake_from_tables, union_lakes

__all__ = ["Lake", "lake_from_table", "lake_from_tables", "union_lakes"]
