"""Flagship plan: daily records of all crops to the published 14-column weekly panel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid import values
from pricegrid.functions.sizes import size_checked_broadcast
from pricegrid.operators import panel as P


def market_panel(daily: DataFrame, markets: DataFrame,
                 bounds: Mapping[str, tuple[float, float]] = values.PRICE_CLIP,
                 min_coverage: float = values.MIN_REAL_COVERAGE, **options) -> DataFrame:
    """``markets`` holds one row per market_id and is joined last, on the reduced panel. Its size is
    measured, so the panel is not shuffled again for a market list that fits into a broadcast."""
    panel = P.coverage_filter(P.build_panel(daily, bounds, **options), min_coverage)
    names = [c for c in ("state", "state_code", "district", "market") if c in markets.columns]
    dimension = size_checked_broadcast(markets.select("market_id", *names))
    return panel.join(dimension, "market_id", "left").select(
        "crop", *names, "market_id", "week_start", "iso_year", "iso_week",
        P.PRICE, P.ARRIVALS, "trading_days", "imputed", "imputed_method")


def write_panel(panel: DataFrame, path: str) -> None:
    """One folder per crop; the reader prunes on it."""
    panel.hint("rebalance", "crop").sortWithinPartitions("crop", "market_id", "week_start").write.mode("overwrite").partitionBy("crop").parquet(path)
