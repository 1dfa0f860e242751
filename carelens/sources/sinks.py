"""Writers of report tables (Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from carelens.plans.line_list import COLUMNS


def save_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Materialize a result (the report's ``CREATE TABLE ... AS``). Column names such as
    ``DateConfirmedHIV+`` are valid Parquet names and round-trip unchanged."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_line_list(df: DataFrame, path: str) -> None:
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"not a line list, missing columns: {missing[:5]}")
    save_table(df, path)
