"""Feature matrix of the forecasting models: one window specification over (crop, market)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid import values
from pricegrid.operators import cleaning as C
from pricegrid.operators import windows as W

# Feature names are fixed values: saved models and published tables refer to columns by these names.
PRICE_FEATURES = (
    [f"price_lag_{k}" for k in values.PRICE_LAGS]
    + [f"price_roll_{s}_{n}" for s in ("mean", "std") for n in values.PRICE_WINDOWS]
    + ["price_yoy", "sin_week", "cos_week", "sin2_week", "cos2_week", "iso_week", "year_trend", "market_enc", "state_enc",
       "season_peak_arrival", "season_lean", "season_kharif", "season_rabi_arrival", "season_harvest", "season_storage"])
ARRIVAL_FEATURES = (
    ["log_arr"] + [f"arr_lag_{k}" for k in values.ARRIVAL_LAGS] + [f"arr_roll_mean_{n}" for n in values.ARRIVAL_WINDOWS])
LAYER_ORDER = ["price", "arrivals", "macro", "climate", "satellite", "infrastructure", "policy"]


def build_features(panel: DataFrame, base_year: int = values.BASE_YEAR,
                   seasons: Mapping[str, Mapping[str, Sequence[int]]] = values.SEASON_MONTHS) -> DataFrame:
    """Panel rows plus price, arrival, calendar, season and encoding features; crop stays a column."""
    rows = C.log_transforms(panel).drop("price_back", "log_arr_clip1")
    rows = W.lags(rows, "log_price", "price_lag_")
    rows = W.trailing_stats(rows)
    rows = W.arrival_lags(rows)
    rows = rows.withColumn("price_yoy", F.lag("log_price", 52).over(W.by()))
    rows = C.cyclic_features(rows, "iso_week")
    rows = C.season_flags(rows, seasons=seasons)
    rows = rows.withColumn("year_trend", F.year("week_start") - base_year)
    encoded = {"market_id": "market_enc", "state": "state_enc"} if "state" in panel.columns else {"market_id": "market_enc"}
    # the codes need the panel's keys only, not its features
    return C.categorical_codes(rows, "crop", encoded, domain=panel)


def layered_feature_sets(layers: Mapping[str, Sequence[str]], present: Sequence[str]) -> dict[str, list[str]]:
    """M0 price only, M1 + arrivals, ... each adding one layer; columns the crop does not have are left out."""
    sets, sofar = {}, []
    for i, layer in enumerate(name for name in LAYER_ORDER if name in layers):
        sofar = sofar + [c for c in layers[layer] if c in present]
        sets[f"M{i}"] = list(sofar)
    return sets
