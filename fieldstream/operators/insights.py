"""Questions to the archive and to recent events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.sources.archive import in_days

MOST_WINDOWS, MOST_HOTSPOTS, BINS, NEWEST = 5000, 100, 60, 5000


@dataclass(frozen=True)
class Box:
    """An inclusive box, checked on creation."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float

    def __post_init__(self):
        if not (-90 <= self.min_lat < self.max_lat <= 90 and -180 <= self.min_lon < self.max_lon <= 180):
            raise ValueError("a box needs min < max within the ranges of latitude and longitude")

    def holds(self, lat: Column, lon: Column) -> Column:
        return lat.between(self.min_lat, self.max_lat) & lon.between(self.min_lon, self.max_lon)


def within(archive: DataFrame, box: Box | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with a centroid in the box (none: left out) and window_start in [start, end]; folders by ``window_date`` are pruned."""
    if box:
        archive = archive.where(box.holds(F.col("centroid_latitude"), F.col("centroid_longitude")))
    for text, test in ((start, F.col("window_start").__ge__), (end, F.col("window_start").__le__)):
        if text:
            archive = archive.where(test(F.lit(text).cast("timestamp")))
    return archive.where(in_days("window_date", start, end)) if "window_date" in archive.columns else archive


def summary(archive: DataFrame) -> DataFrame:
    """One row: rows, cells, anomalies, first and last window, peak; zeros and nulls for an empty archive."""
    return archive.agg(
        F.count("*").alias("windows"), F.count_distinct("geohash").alias("cells"), F.count_if("anomaly").alias("anomalies"), F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"), F.max("cpm_max").alias("peak_cpm"),
    )


def weighted_mean() -> Column:
    """Mean of means weighted by their counts; exact decimal sums."""
    weight = F.when(F.col("cpm_avg").isNotNull(), F.col("count"))
    return F.sum((F.col("cpm_avg").cast("decimal(18,4)") * weight.cast("decimal(12,0)")).cast("decimal(30,4)")).cast("double") / F.nullif(F.sum("count"), F.lit(0))


def timeseries(archive: DataFrame, limit: int = MOST_WINDOWS) -> DataFrame:
    """The newest ``limit`` windows over all cells, in ascending order."""
    rows = archive.groupBy("window_start").agg(
        F.sum("count").alias("count"), weighted_mean().alias("cpm_avg"), F.max("cpm_max").alias("cpm_max"), F.coalesce(F.sum("danger_count"), F.lit(0)).alias("danger_count"), F.count_if("anomaly").alias("anomaly_cells"),
    )
    return rows.orderBy(F.desc("window_start")).limit(limit).orderBy("window_start")


def trend_points(series: DataFrame) -> DataFrame:
    """A time series with a flag for windows that have an anomaly; rows without a time are left out."""
    return series.where("window_start is not null").withColumn("flagged", F.col("anomaly_cells") > 0).orderBy("window_start")


def hotspots(archive: DataFrame, limit: int = 10) -> DataFrame:
    """The cells with the highest peaks, with their share of the highest one."""
    if not 1 <= limit <= MOST_HOTSPOTS:
        raise ValueError(f"limit must be 1 to {MOST_HOTSPOTS}")
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,6)")).cast("double") / F.count(c)
    rows = archive.groupBy("geohash").agg(
        mean("centroid_latitude").alias("latitude"), mean("centroid_longitude").alias("longitude"), F.max("cpm_max").alias("peak_cpm"), weighted_mean().alias("cpm_avg"), F.sum("count").alias("count"),
        F.count("*").alias("windows"), F.count_if("anomaly").alias("anomaly_windows"),
    )
    top = rows.orderBy(F.desc_nulls_last("peak_cpm"), "geohash").limit(limit)
    return share_of_peak(top, "peak_cpm").orderBy(F.desc_nulls_last("peak_cpm"), "geohash")


def share_of_peak(rows: DataFrame, column: str) -> DataFrame:
    """Adds share: the value against the highest one (1 at least), and never under 0.03; for a short ranked list."""
    peak = F.greatest(F.lit(1.0), F.coalesce(F.max(column).over(Window.partitionBy()), F.lit(1.0)))
    return rows.withColumn("share", F.greatest(F.lit(0.03), F.col(column) / peak))


def density(events: DataFrame, time: str = "captured_at", order: str = "seq", newest: int = NEWEST, bins: int = BINS) -> DataFrame:
    """(bin, count) over the times of the newest events: equal bins from the first to the last time, which falls into the last bin; empty ones count 0."""
    recent = events.where(F.col(time).isNotNull()).orderBy(F.desc(order), F.desc(time)).limit(newest).select(F.unix_millis(time).alias("t"))
    every_row = Window.partitionBy()  # at most ``newest`` rows
    held = recent.select("t", F.min("t").over(every_row).alias("lo"), F.max("t").over(every_row).alias("hi"))
    placed = held.select(F.least(F.expr(f"(t - lo) * {bins} div greatest(hi - lo, 1)"), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").count()
    every = events.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def observed(df: DataFrame, name: str, sensor_time: str = "captured_at") -> DataFrame:
    """``df`` with metrics that a listener can read: rows, rows without a count, and the last event time."""
    return df.observe(name, F.count("*").alias("rows"), F.count_if(F.col("cpm").isNull()).alias("without_value"), F.max(sensor_time).alias("last_event"))


def observed_messages(messages: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Messages with metrics: how many came, their bytes, and how many are no JSON objects."""
    malformed = ~F.coalesce(F.try_parse_json(value).isNotNull() & F.trim(value).startswith("{"), F.lit(False))
    return messages.observe(name, F.count("*").alias("consumed"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).alias("bytes"), F.count_if(malformed).alias("malformed"))
