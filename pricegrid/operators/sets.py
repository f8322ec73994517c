"""Set operations, top-k, sampling and sorted output."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid.functions.sizes import hashed


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key under an explicit order, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    tail = [c for c in rest if c not in lead]
    first = df.groupBy(*keys).agg(F.min(F.struct(*lead, *tail)).alias("__row"))
    return first.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def set_difference(left: DataFrame, right: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of left that right lacks, duplicates kept. With ``rows``, about how many left has, they are compared in as many
    tasks as that needs."""
    right = right.select(*left.columns)
    if rows is None:
        return left.exceptAll(right)
    names = left.columns
    both = left.withColumn("__n", F.lit(1)).union(right.withColumn("__n", F.lit(-1)))
    left_over = hashed(both, names, rows).groupBy(*names).agg(F.sum("__n").alias("__n")).where(F.col("__n") > 0)
    return left_over.select(*names, F.explode(F.array_repeat(F.lit(1), F.col("__n").cast("int"))).alias("__one")).drop("__one")


def missing_names(listed: Sequence[str], df: DataFrame) -> list[str]:
    """Listed columns the frame does not have."""
    present = set(df.columns)
    return [c for c in listed if c not in present]


def index_intersection(rankings: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys common to all rankings with the columns of each."""
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), rankings)


def top_k(df: DataFrame, k: int, order_by: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order_by).limit(k)


def sort_output(df: DataFrame, columns: Sequence[str], total_order: bool = True) -> DataFrame:
    """Range-partitioned total order, or sorted inside the existing partitions."""
    return df.orderBy(*columns) if total_order else df.sortWithinPartitions(*columns)


def seeded_sample(df: DataFrame, n: int, group: str, ident: Sequence[str], seed: int = 42, salts: int = 64) -> DataFrame:
    """n rows per group in the order of a seeded hash of the row's identity: the same rows every run. The hash is the MD5
    of the identity and the seed as text, joined by '|', which any engine can repeat.

    Each salted part of a group is cut to n rows first, so no task sorts a whole hot group.
    """
    drawn = df.withColumn("__draw", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ident], F.lit(str(seed))))).withColumn(
        "__salt", F.pmod(F.xxhash64("__draw"), F.lit(salts)))

    def first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("__draw", *ident)
        return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")

    return first(first(drawn, [group, "__salt"]), [group]).drop("__draw", "__salt")


def compare_series(df: DataFrame, ids: Sequence[int], value: str, last: int = 104, max_ids: int = 15,
                   keys: Sequence[str] = ("crop", "market_id"), week: str = "week_start") -> DataFrame:
    """Last weeks of up to 15 chosen ids; ``has_value`` is false where an id has no value at all in them."""
    if len(ids) > max_ids:
        raise ValueError(f"choose at most {max_ids} ids")
    chosen = df.where(F.col(keys[-1]).isin(list(ids)))
    w = Window.partitionBy(*keys).orderBy(F.col(week).desc())
    tail = chosen.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= last).drop("__rn")
    return tail.withColumn("has_value", F.count(value).over(Window.partitionBy(*keys)) > 0)


def leading_entities(df: DataFrame, group: str, ident: str, k: int) -> DataFrame:
    """Rows of each group's ``k`` entities with most rows; ties go to the smaller id."""
    counts = df.groupBy(group, ident).agg(F.count(F.lit(1)).alias("__n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("__n").desc(), ident))
    chosen = counts.withColumn("__place", place).where(F.col("__place") <= k).select(group, ident)
    return df.join(chosen, [group, ident], "left_semi")
