"""Sinks: append-only score log, application snapshots, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("stage").parquet(path)


def write_snapshot(applications: DataFrame, path: str) -> None:
    """A snapshot goes to a new place; the caller switches to it once it is complete."""
    applications.write.mode("errorifexists").parquet(path)


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """Key columns and the whole row as one JSON text."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
