"""Broadcast decisions from measured sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid.session import materialise


#: rows that one task of ``hashed`` work is meant to hold
ROWS_PER_TASK = 250_000
#: most bytes of a side that is broadcast, by the declared width of its columns
MAX_BYTES = 64 << 20


def size_checked_broadcast(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Broadcast hint when a bounded count shows at most ``max_rows`` rows and at most MAX_BYTES; otherwise the
    frame as it is, which joins by sort-merge with skew splitting."""
    most = min(max_rows, MAX_BYTES // max(1, df._jdf.schema().defaultSize()))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over as many tasks as a shuffle has, for small tables with costly Python work per row.

    The number is named, so adaptive execution does not merge the small partitions into one.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hashed(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Hash partitioning for work that grows a frame to ``rows`` rows in the same partitions: a task for ROWS_PER_TASK of
    them, so that no task's share grows with the table. Small work is left to adaptive execution, which sees sizes before
    the growth only."""
    tasks = -(-rows // ROWS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def small_side(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """For a side that is costly to compute: materialise it once, then measure and hint."""
    return size_checked_broadcast(materialise(df), max_rows)
