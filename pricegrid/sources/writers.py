"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("crop",), fmt: str = "parquet",
                max_rows_per_file: int = 10_000_000) -> None:
    """One folder per crop and a readable whole; rebalancing splits a hot crop over writers by its size."""
    df.hint("rebalance", *partition_by).write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file).format(
        fmt).partitionBy(*partition_by).save(path)


def json_meta(df: DataFrame, key: Column, **fields: str) -> DataFrame:
    """(key, json) rows, one JSON object per row."""
    body = F.struct(*[F.col(source).alias(name) for name, source in fields.items()])
    return df.select(key.alias("key"), F.to_json(body).alias("json"))


def write_json_meta(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
