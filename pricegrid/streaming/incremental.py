"""The two incremental ideas of the batch build as streaming jobs: append after the high-water mark, and
the weekly aggregate kept up to date while files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pricegrid.operators.panel import ARRIVALS, PRICE
from pricegrid.sources.readers import existing_paths


def read_daily_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def weekly_stream(daily: DataFrame, time: str = "arrival_time", price: str = "modal_price_rs_per_quintal",
                  quantity: str = "total_arrivals_tonnes", lateness: str = "14 days") -> DataFrame:
    """Weighted weekly means over Monday weeks; a week is final once the watermark has passed it.

    Windows count from the epoch, a Thursday, so an offset of four days makes them start on Mondays.
    """
    valid = daily.where(F.col(price).isNotNull() & (F.col(quantity) > 0)).withWatermark(time, lateness)
    week = F.window(time, "7 days", "7 days", "4 days")
    day_bit = F.expr(f"shiftleft(1, weekday({time}))")
    return valid.groupBy("crop", "market_id", week.alias("w")).agg(
        (F.sum(F.col(price) * F.col(quantity)) / F.sum(quantity)).alias(PRICE), F.sum(quantity).alias(ARRIVALS),
        F.bit_count(F.bit_or(day_bit)).cast("int").alias("trading_days"),
    ).select("crop", "market_id", F.to_date("w.start").alias("week_start"), PRICE, ARRIVALS, "trading_days")


def append_newer(table: str, checkpoint: str, stream: DataFrame, date: str) -> StreamingQuery:
    """Append each batch's rows later than the last stored date. A repeated batch finds its rows stored and
    adds nothing."""
    def store(batch: DataFrame, _: int) -> None:
        fresh = batch
        if existing_paths(batch.sparkSession, [f"{table}/*.parquet"]):
            mark = batch.sparkSession.read.parquet(table).agg(F.max(date)).first()[0]
            if mark is not None:
                fresh = batch.where(F.col(date) > F.lit(mark))
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
