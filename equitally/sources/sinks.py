"""Sinks (S6, S7): data tables as Parquet, reports as CSV / JSON.

Everything is written by all tasks in parallel and at any size.  One file is
written on request only (``single_file``), for reports that are known to be
small: that one task then writes the whole report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """S6 for data: parallel Parquet write, optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """S6 for reports: header CSV, one file per task or one in all."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_metrics_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Metrics rows as JSON lines, one file per task or one in all."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)
