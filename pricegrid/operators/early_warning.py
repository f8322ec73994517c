"""Early-warning episodes and placebo windows on a crop-week series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid import values

Episode = tuple[str, str, str]


def _episode_array(episodes: Sequence[Episode]) -> Column:
    return F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(crop).alias("crop"), F.lit(day).cast("date").alias("day"))
        for name, crop, day in episodes])


def episode_labels(rows: DataFrame, episodes: Sequence[Episode] = values.EPISODES,
                   deviation_col: str = "price_vs_seasonal_norm", lookback_weeks: int = values.EPISODE_LOOKBACK_WEEKS,
                   deviation: float = values.EPISODE_DEVIATION) -> DataFrame:
    """Label 1 inside the weeks before an action while the price stands above its seasonal norm."""
    hits = F.filter(_episode_array(episodes), lambda e: (
        (e["crop"] == F.col("crop"))
        & (F.col("week_start") >= F.date_sub(e["day"], 7 * lookback_weeks))
        & (F.col("week_start") < e["day"])
        & F.coalesce(F.col(deviation_col) >= deviation, F.lit(False))))
    names = F.transform(hits, lambda e: e["name"])
    # the later episode in the list wins where windows overlap
    return rows.withColumn("label", (F.size(names) > 0).cast("int")).withColumn(
        "episode", F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("")))


def placebo_windows(rows: DataFrame, episodes: Sequence[Episode] = values.EPISODES,
                    deviation_col: str = "price_vs_seasonal_norm", score: str = "score",
                    lookback_weeks: int = values.EPISODE_LOOKBACK_WEEKS,
                    deviation: float = values.EPISODE_DEVIATION) -> DataFrame:
    """Mean score of the qualifying weeks before each non-overlapping end point, 0 if there is none.

    End points are every ``lookback_weeks``-th row of the crop's series that keep twice that distance
    from every real episode. A partition is one crop's weekly series.
    """
    order = Window.partitionBy("crop").orderBy("week_start")
    far = ~F.exists(_episode_array(episodes), lambda e: (e["crop"] == F.col("crop")) & (
        F.abs(F.datediff(F.col("week_start"), e["day"])) < lookback_weeks * 2 * 7))
    numbered = rows.withColumn("__i", F.row_number().over(order) - 1)
    ends = numbered.where((F.col("__i") > 0) & (F.col("__i") % lookback_weeks == 0) & far).select(
        "crop", F.col("week_start").alias("end_week"))
    reached = ends.withColumn("week_start", F.explode(F.sequence(
        F.date_sub("end_week", 7 * lookback_weeks), F.date_sub("end_week", 7), F.expr("interval 7 days"))))
    hot = F.col(deviation_col) >= deviation
    return (
        reached.join(rows.select("crop", "week_start", deviation_col, F.col(score).alias("__score")), ["crop", "week_start"], "left")
        .groupBy("crop", "end_week")
        .agg(F.coalesce(F.avg(F.when(hot, F.col("__score"))), F.lit(0.0)).alias("intensity"), F.count_if(hot).alias("n_weeks"))
    )
