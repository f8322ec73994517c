"""Exact order statistics that stay distributed when one key holds most of the rows.

A window over a whole crop would sort that crop in one task. Here ties are summed map-side first, the
distinct values are cut into buckets at approximate quantiles, and only a bucket is sorted in one task. The
cut points decide the balance, never the result. They come from a first scan whose result (one row per key)
is materialised and measured, so the rows are not shuffled by a hot key to receive it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid.functions.sizes import small_side


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__k_{k}"])
    return left.join(renamed, condition, how).drop(*[f"__k_{k}" for k in keys])


def ordered_cumulative(df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column],
                       descending: bool = False, buckets: int = 200, keep_bucket: bool = False) -> DataFrame:
    """One row per (keys, value): each measure's sum and its running sum ``cum_<name>`` up to the value.

    Rows with a null value are left out. ``keep_bucket`` leaves the bucket number for further passes.
    """
    if not keys:
        whole = df.withColumn("__all", F.lit(0))
        return ordered_cumulative(whole, ["__all"], value, measures, descending, buckets, keep_bucket).drop("__all")
    keys = list(keys)
    names = list(measures)
    tied = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(expr).alias(name) for name, expr in measures.items()])
    )
    cuts = [i / buckets for i in range(1, buckets)]
    splits = small_side(df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), cuts, buckets * 20).alias("__cuts")), 10_000)
    placed = (
        _null_safe_join(tied, splits, keys)
        .withColumn("__bucket", F.size(F.filter("__cuts", lambda cut: cut < F.col(value).cast("double"))))
        .drop("__cuts")
    )
    order = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "__bucket")
        .agg(*[F.sum(n).alias(f"__sum_{n}") for n in names])
        .select(*keys, "__bucket",
                *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in names])
    )
    value_order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy(*keys, "__bucket").orderBy(value_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _null_safe_join(placed, offsets, [*keys, "__bucket"])
        .select(*keys, value, *(["__bucket"] if keep_bucket else []), *names,
                *[(F.sum(n).over(inside) + F.col(f"__off_{n}")).alias(f"cum_{n}") for n in names])
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Rank from 1 with ties sharing the mean of their places; null values keep a null rank."""
    if not keys:
        return average_rank(df.withColumn("__all", F.lit(0)), ["__all"], value, out, descending).drop("__all")
    keys = list(keys)
    ranks = ordered_cumulative(df, keys, value, {"__n": F.lit(1)}, descending).select(
        *keys, value, (F.col("cum___n") - (F.col("__n") - 1) / 2).cast("double").alias(out))
    return _null_safe_join(df, ranks, [*keys, value], "left")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float],
                      accuracy: int = 200_000) -> DataFrame:
    """Exact linear-interpolated percentiles per key, plus ``n``.

    A sketch with a guaranteed rank error brackets each percentile; only the distinct values inside
    the brackets are ranked. A group smaller than the sketch's accuracy is bracketed by itself.
    """
    if not keys:
        return exact_percentiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probabilities, accuracy).drop("__all")
    keys = list(keys)
    names = list(probabilities)
    eps = 4.0 / accuracy
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    edges = [e for p in probabilities.values() for e in (max(p - eps, 0.0), min(p + eps, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", edges, accuracy).alias("__edges"))
    lo, hi = [], []
    for i, p in enumerate(probabilities.values()):
        lo.append(F.col("__min") if p - eps <= 0 else F.col("__edges")[2 * i])
        hi.append(F.col("__max") if p + eps >= 1 else F.col("__edges")[2 * i + 1])
    sketch = sketch.select(
        *keys, "n",
        F.array(*[
            F.struct(
                F.lit(i).alias("i"), lo[i].alias("lo"), hi[i].alias("hi"),
                F.floor((F.col("n") - 1) * F.lit(p)).alias("below"),
                ((F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))).alias("part"))
            for i, p in enumerate(probabilities.values())
        ]).alias("__targets"))
    joined = _null_safe_join(rows, small_side(sketch, 100_000), keys)
    # one row per (key, target, distinct value in the bracket); everything left and right of the bracket
    # is one counted row each, which keeps the neighbouring value
    v, t = F.col("__v"), F.col("t")
    zone = F.when(v < t["lo"], 0).when(v <= t["hi"], 1).otherwise(2)
    tied = (
        joined.select(*keys, "n", "__v", F.explode("__targets").alias("t"))
        .withColumn("__zone", zone)
        .groupBy(*keys, "n", "t", "__zone", F.when(F.col("__zone") == 1, v).alias("__inside"))
        .agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    )
    w = Window.partitionBy(*keys, "n", "t").orderBy("__zone", "__inside").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = tied.withColumn("__end", F.sum("__c").over(w)).withColumn("__first", F.col("__end") - F.col("__c"))

    def at(index: Column) -> Column:
        here = (index >= F.col("__first")) & (index < F.col("__end"))
        known = F.when((F.col("__zone") == 1) | (index == F.col("__first")), F.col("__low")).when(
            index == F.col("__end") - 1, F.col("__high"))
        return F.max(F.when(here, known))

    picked = ranked.groupBy(*keys, "n", "t").agg(
        at(F.col("t.below")).alias("__a"),
        at(F.least(F.col("t.below") + 1, F.col("n") - 1)).alias("__b"))
    value_at = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("t.part")
    return picked.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("t.i") == i, value_at)).alias(name) for i, name in enumerate(names)])
