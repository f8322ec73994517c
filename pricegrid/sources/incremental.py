"""Incremental merges of newer data into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_same_schema(existing: DataFrame, new: DataFrame) -> None:
    have = [(f.name, f.dataType) for f in existing.schema.fields]
    got = [(f.name, f.dataType) for f in new.schema.fields]
    if have != got:
        raise ValueError(f"schemas differ: {set(have) ^ set(got) or 'column order'}")


def append_after_high_water_mark(existing: DataFrame, new: DataFrame, date: str) -> DataFrame:
    """Append only rows later than the last stored date; nothing newer leaves the table as it is."""
    assert_same_schema(existing, new)
    mark = existing.agg(F.max(date).alias("m")).scalar()
    fresh = new.where(mark.isNull() | (F.col(date) > mark))
    return existing.unionByName(fresh)


def replace_tail(existing: DataFrame, new: DataFrame, date: str, cutoff: str) -> DataFrame:
    """Rows before the cutoff from the stored table, everything from the new one."""
    assert_same_schema(existing, new)
    return existing.where(F.col(date) < F.lit(cutoff).cast("date")).unionByName(new)
