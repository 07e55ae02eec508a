"""Cells: tumbling windows per geohash, rolling statistics and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.functions import expr as X

#: Windows that the rolling mean looks back, and the score from which a window is an anomaly.
BACK, ANOMALY = 6, 3.0


def exact_mean(c: str, scale: int):
    """Mean over exact decimal sums, so that it doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast(f"decimal(18,{scale})")).cast("double") / F.count(c)


def cell_windows(events: DataFrame, precision: int = 5, window: str = "60 seconds", time: str = "captured_at") -> DataFrame:
    """Per cell and epoch-aligned window: counts, mean (4 digits), extremes, classes, worst class and mean position (6 digits)."""
    placed = events.withColumn("geohash", X.geohash(F.col("latitude"), F.col("longitude"), precision)).where("geohash is not null")
    of = lambda level: F.count_if(F.col("classification") == level).alias(level)
    rows = placed.groupBy("geohash", F.window(time, window).alias("w")).agg(
        F.count("*").alias("count"), X.round_to(exact_mean("cpm", 4), 4).alias("cpm_avg"), F.max("cpm").alias("cpm_max"), F.min("cpm").alias("cpm_min"), *map(of, X.LEVELS),
        F.max(X.severity(F.col("classification"))).alias("worst"), X.round_to(exact_mean("latitude", 6), 6).alias("centroid_latitude"), X.round_to(exact_mean("longitude", 6), 6).alias("centroid_longitude"),
    )
    return rows.select(
        "geohash", F.lit(precision).alias("precision"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", "cpm_avg", "cpm_max", "cpm_min",
        F.struct(*X.LEVELS).alias("class_counts"), X.level_name(F.col("worst")).alias("worst_classification"), "centroid_latitude", "centroid_longitude",
    )


def rolling(cells: DataFrame, back: int = BACK, anomaly: float = ANOMALY) -> DataFrame:
    """Adds rolling_cpm_avg, cpm_zscore and anomaly, by the order of the windows of a cell.

    Windows without a mean get nulls and don't enter the baseline.  The score is
    taken against the earlier windows only (population deviation); fewer than two of them, or none
    that differ, give null.  Sums of ten-thousandths are exact.
    """
    lane = Window.partitionBy("geohash", F.col("cpm_avg").isNull()).orderBy("window_start")
    prior, upto = lane.rowsBetween(-back, -1), lane.rowsBetween(-back, 0)
    x = F.round(F.col("cpm_avg") * 10_000).cast("decimal(18,0)")
    square = (x * x).cast("decimal(36,0)")
    n, s, q = F.count("cpm_avg").over(prior), F.sum(x).over(prior), F.sum(square).over(prior)
    marked = cells.select("*", n.alias("__n"), s.cast("decimal(18,0)").alias("__s"), q.cast("decimal(36,0)").alias("__q"), x.alias("__x"), (F.sum(x).over(upto).cast("double") / F.count("cpm_avg").over(upto) / 10_000).alias("__r"))
    spread = F.col("__n") * F.col("__q") - F.col("__s") * F.col("__s")
    z = F.when((F.col("__n") >= 2) & (spread > 0), X.round_to((F.col("__n") * F.col("__x") - F.col("__s")).cast("double") / F.sqrt(spread.cast("double")), 4))
    has = F.col("cpm_avg").isNotNull()
    out = marked.withColumn("rolling_cpm_avg", F.when(has, X.round_to(F.col("__r"), 4))).withColumn("cpm_zscore", F.when(has, z))
    return out.withColumn("anomaly", F.coalesce(F.abs("cpm_zscore") >= anomaly, F.lit(False))).select(*cells.columns, "rolling_cpm_avg", "cpm_zscore", "anomaly")
