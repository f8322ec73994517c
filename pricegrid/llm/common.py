"""What the operators share: the query registry, the definition of a word, row numbering."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid.session import materialise, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: the six ASCII white-space characters; everything else belongs to a word
SPACE = r"[\x20\x09-\x0D]+"


#: bytes of an Arrow batch; rows hold whole texts, and a batch is held by both sides
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches small, as rows hold whole texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def shuffles_removed_after_use(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action go when it has ended. For actions that leave a table or a checkpoint."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as a query, with its DuckDB SQL where there is one."""

    def keep(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def normal_space(text: Column) -> Column:
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows from 0 in the given order, without gaps and without one task seeing them all.

    Sampled splitters range-partition the rows; a row's number is its place in its sorted partition plus the sizes
    of the partitions before. Only these sizes (one row a partition) meet in one task. The placed rows are
    materialised first: numbers taken twice from a shuffle could differ where rows tie.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    placed = materialise(
        df.withColumns(dict(zip(keys, order, strict=True)))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({"__part": F.spark_partition_id(),
                      "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        .drop(*keys))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    return (
        placed.join(F.broadcast(offsets), "__part")  # one row for each partition of the shuffle
        .withColumn(name, F.col("__before") + F.col("__at"))
        .drop("__part", "__at", "__before"))
