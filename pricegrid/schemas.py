"""Explicit schemas; every text number or date is coerced by the readers, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_DAILY = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("commodity", T.StringType()),
    T.StructField("commodity_id", T.IntegerType()),
    T.StructField("state", T.StringType()),
    T.StructField("state_id", T.IntegerType()),
    T.StructField("state_code", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("district_id", T.LongType()),
    T.StructField("market", T.StringType()),
    T.StructField("market_id", T.LongType(), False),
    T.StructField("arrival_date", T.DateType(), False),
    T.StructField("arrival_date_raw", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("variety", T.StringType()),
    T.StructField("arrivals_tonnes", T.DoubleType()),
    T.StructField("total_arrivals_tonnes", T.DoubleType()),
    T.StructField("min_price_rs_per_quintal", T.DoubleType()),
    T.StructField("max_price_rs_per_quintal", T.DoubleType()),
    T.StructField("modal_price_rs_per_quintal", T.DoubleType()),
])

WEEKLY_PANEL = T.StructType([
    T.StructField("crop", T.StringType(), False),
    T.StructField("state", T.StringType()),
    T.StructField("state_code", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("market_id", T.LongType(), False),
    T.StructField("week_start", T.DateType(), False),
    T.StructField("iso_year", T.IntegerType()),
    T.StructField("iso_week", T.IntegerType()),
    T.StructField("modal_price_weighted", T.DoubleType()),
    T.StructField("arrivals_tonnes_week", T.DoubleType()),
    T.StructField("trading_days", T.IntegerType()),
    T.StructField("imputed", T.IntegerType()),
    T.StructField("imputed_method", T.StringType()),
])

POLICY_EVENTS = T.StructType([
    T.StructField(name, kind)
    for name, kind in [
        ("event_date", T.DateType()), ("publication_date", T.DateType()),
        ("effective_date", T.DateType()), ("crop", T.StringType()),
        ("record_type", T.StringType()), ("policy_type", T.StringType()),
        ("policy_direction", T.StringType()), ("policy_intensity", T.IntegerType()),
        ("source_agency", T.StringType()), ("notification_no", T.StringType()),
        ("source_url", T.StringType()), ("description", T.StringType()),
        ("quantity_mt", T.DoubleType()), ("value_usd_million", T.DoubleType()),
        ("value_inr_crore", T.DoubleType()), ("price_inr_per_kg", T.DoubleType()),
        ("price_inr_per_quintal", T.DoubleType()), ("price_usd_per_mt", T.DoubleType()),
        ("verification_status", T.StringType()), ("notes", T.StringType()),
    ]
])

PREDICTIONS = T.StructType([
    T.StructField("variant", T.StringType(), False),
    T.StructField("crop", T.StringType(), False),
    T.StructField("fold", T.IntegerType(), False),
    T.StructField("horizon_weeks", T.IntegerType(), False),
    T.StructField("market_id", T.LongType(), False),
    T.StructField("week_start", T.DateType(), False),
    T.StructField("y_true", T.DoubleType()),
    T.StructField("y_pred", T.DoubleType()),
])
