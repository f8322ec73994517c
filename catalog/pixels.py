"""Zonal statistics; band values come from the embedding elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import CTES, query
from pricegrid.operators import pixels as X

CTES["pixel"] = """
SELECT label AS zone_id, vec_id AS pixel, CAST(DATE '2024-01-01' + CAST(pos AS INTEGER) AS DATE) AS date, abs(v) * 2 AS nir, abs(v) * abs(v) AS red, abs(v) * 0.3 AS blue, CAST(floor(abs(v) * 100) AS INTEGER) % 12 AS scl, CAST(floor(abs(v) * 1000) AS INTEGER) % 256 AS qc
FROM (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)"""


def pixel(spark, sf):
    v = F.abs(F.col("v").cast("double"))
    e = fx.table(spark, sf, "embeddings").select(F.col("label").alias("zone_id"), F.col("vec_id").alias("pixel"), F.posexplode("embedding").alias("pos", "v"))
    return e.select("zone_id", "pixel", F.date_add(F.lit("2024-01-01").cast("date"), F.col("pos")).alias("date"), (v * 2).alias("nir"), (v * v).alias("red"), (v * 0.3).alias("blue"),
                    (F.floor(v * 100).cast("int") % 12).alias("scl"), (F.floor(v * 1000).cast("int") % 256).alias("qc"))


@query("quality_mask", """
SELECT zone_id, pixel, date, rnd(CASE WHEN scl IN (4,5,6,7,11) THEN nir END, 6) AS nir, rnd(CASE WHEN qc & 3 < 2 THEN red END, 6) AS red, rnd(CASE WHEN scl <= 1 THEN blue END, 6) AS blue FROM pixel
""")
def quality_mask(spark, sf):
    p = X.quality_mask(pixel(spark, sf), X.scene_class_clear("scl"), ["nir"])
    p = X.quality_mask(X.quality_mask(p, X.low_bits_produced("qc"), ["red"]), X.summary_qa_good("scl"), ["blue"])
    return p.select("zone_id", "pixel", "date", fx.r("nir", 6), fx.r("red", 6), fx.r("blue", 6))


CTES["indices"] = """
SELECT zone_id, pixel, date, CASE WHEN scl IN (4,5,6,7,11) AND nir + red <> 0 THEN (nir - red) / (nir + red) END AS ndvi, CASE WHEN scl IN (4,5,6,7,11) AND nir + 6 * red - 7.5 * blue + 1 <> 0 THEN 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1) END AS evi FROM pixel"""


def indices(spark, sf):
    return X.vegetation_indices(X.quality_mask(pixel(spark, sf), X.scene_class_clear("scl"), ["nir", "red", "blue"]))


@query("vegetation_indices", 'SELECT zone_id, pixel, date, rnd(ndvi, 6) AS "NDVI", rnd(evi, 6) AS "EVI" FROM indices')
def vegetation_indices(spark, sf):
    return indices(spark, sf).select("zone_id", "pixel", "date", fx.r("NDVI", 6), fx.r("EVI", 6))


@query("unit_scale", """
SELECT pixel, date, rnd(nir * 300 - 273.15, 6) AS celsius, rnd(red * 10000 * 0.0001, 6) AS ndvi, rnd(blue * 50000 * 0.02 - 273.15, 6) AS lst, rnd(nir * 10 / 5, 6) AS daily_mm FROM pixel
""")
def unit_scale(spark, sf):
    p = pixel(spark, sf).withColumns({"k": F.col("nir") * 300, "dn": F.col("red") * 10000, "ln": F.col("blue") * 50000, "mm": F.col("nir") * 10})
    return p.select("pixel", "date", fx.rnd(X.kelvin_to_celsius("k"), 6).alias("celsius"), fx.rnd(X.vegetation_scale("dn"), 6).alias("ndvi"),
                    fx.rnd(X.land_temperature("ln"), 6).alias("lst"), fx.rnd(X.pentad_to_daily("mm"), 6).alias("daily_mm"))


@query("zonal_reduce", """
SELECT zone_id, date, rnd(avg(ndvi), 6) AS mean, rnd(max(ndvi), 6) AS max, rnd(sum(ndvi), 6) AS sum, rnd(avg(CAST(ndvi > 0.9 AS INTEGER)), 6) AS frac_above, rnd(avg(CAST(ndvi IS NOT NULL AS INTEGER)), 6) AS valid_px_frac, count(ndvi) AS n_valid_px FROM indices GROUP BY ALL
""")
def zonal_reduce(spark, sf):
    out = X.zonal_reduce(indices(spark, sf), "NDVI", 0.9)
    return out.select("zone_id", "date", *[fx.r(c, 6) for c in ("mean", "max", "sum", "frac_above", "valid_px_frac")], "n_valid_px")


@query("half_month_windows", """
WITH c AS (SELECT zone_id, pixel, CAST(CASE WHEN dayofmonth(date) <= 15 THEN date_trunc('month', date) ELSE date_trunc('month', date) + INTERVAL 15 DAY END AS DATE) AS date_start, median(ndvi) AS ndvi, median(evi) AS evi FROM indices GROUP BY ALL)
SELECT zone_id, date_start, rnd(avg(ndvi), 6) AS "NDVI", rnd(avg(evi), 6) AS "EVI", rnd(avg(CAST(ndvi IS NOT NULL AS INTEGER)), 6) AS valid_px_frac, count(*) AS n_px FROM c GROUP BY ALL HAVING avg(ndvi) IS NOT NULL
""")
def half_month_windows(spark, sf):
    out = X.half_month_windows(indices(spark, sf), ["NDVI", "EVI"])
    return out.select("zone_id", "date_start", fx.r("NDVI", 6), fx.r("EVI", 6), fx.r("valid_px_frac", 6), "n_px")
