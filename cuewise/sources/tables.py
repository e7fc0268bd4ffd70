"""Table access: scans, list columns stored as JSON text, typed segment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, condition: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Read a Parquet table; the filter and the column list reach the file scan."""
    frame = spark.read.parquet(path)
    if condition:
        frame = frame.where(condition)
    return frame.selectExpr(*columns) if columns else frame


def decode_list(value: Column) -> Column:
    """JSON text to a list of strings; anything that is not a list becomes an empty list."""
    is_list = F.trim(value).startswith("[")
    parsed = F.from_json(F.when(is_list, value), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def encode_list(value: Column) -> Column:
    return F.to_json(F.coalesce(value, F.array().cast("array<string>")))
