"""Alerts: sustained high readings, cooldown, rising trends, and the region around an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.functions import expr as X

LEAST_BREACHES, COOLDOWN_S, TREND_WINDOWS, TREND_DELTA = 3, 600, 3, 5.0


def sustained_high(events: DataFrame, window: str = "300 seconds", slide: str = "60 seconds", least: int = LEAST_BREACHES, tie: str = "seq") -> DataFrame:
    """Per sensor and sliding window with at least ``least`` readings of class DANGER: the peak, their number, and place and time of the latest (of equals the first by ``tie``)."""
    latest = F.max_by(F.struct("latitude", "longitude", F.col("captured_at").cast("string").alias("at")), F.struct("captured_at", -F.col(tie)))
    rows = events.where("classification = 'DANGER'").groupBy("sensor_id", F.window("captured_at", window, slide).alias("w")).agg(F.count("*").cast("int").alias("breach_count"), F.max("cpm").alias("cpm"), latest.alias("last"))
    return rows.where(F.col("breach_count") >= least).select(
        "sensor_id", F.lit("sustained-high").alias("reason"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cpm", "breach_count", F.lit("DANGER").alias("classification"),
        F.col("last.latitude").alias("latitude"), F.col("last.longitude").alias("longitude"), F.col("last.at").alias("triggered_at"),
    )


#: Gaps that a slice of positions spans.
SLICE_GAPS = 512


def _first(rows: Column, keep) -> Column:
    """The first element that ``keep`` holds for, or null."""
    return F.get(F.filter(rows, keep), F.lit(0))


def _jumps(at: Column, gap: int) -> Column:
    """The jump table of a slice: (entry, exit) for each position at which a walk can come in, and the last one it then takes.

    A walk comes in at the first position that is a gap after some position before the slice, so at one less than a gap after the first of the slice, or at the next one.
    """
    first = F.get(at, F.lit(0))
    near = F.filter(at, lambda x: x < first + gap)
    after = F.slice(F.filter(at, lambda x: x >= first + gap), 1, 1)
    leave = lambda e: F.aggregate(F.filter(at, lambda x: x > e), e, lambda last, x: F.when(x - last >= gap, x).otherwise(last))
    return F.transform(F.concat(near, after), lambda e: F.struct(e.alias("entry"), leave(e).alias("exit")))


def spaced(rows: DataFrame, key: str, position: Column, gap: int) -> DataFrame:
    """The rows of each key that a greedy walk takes: the first, then each at least ``gap`` after the last one taken.

    The positions of a key are cut into slices of 512 gaps.  A slice alone tells where a walk leaves it for each
    position at which it can come in; these tables, composed over the slices of a key, give the position taken before each slice, from
    which it is walked on its own.  So a row holds the positions of one slice, or one table for each slice of a key (a hundred years of
    ten-minute gaps are 10,000 slices), and each position is met once for each other one within a gap of it.  Rows without a key or position are left out.
    """
    reach = max(gap, 1)
    placed = rows.withColumn("__at", position.cast("long"))
    points = placed.where(F.col("__at").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"), "__at", F.expr(f"__at div {SLICE_GAPS * reach}").alias("__slice"))
    # few bytes and much work: without a number the small partitions would become one
    dealt = points.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key", "__slice")
    slices = dealt.groupBy("__key", "__slice").agg(F.sort_array(F.collect_set("__at")).alias("at"))
    table = F.struct(F.col("__slice").alias("slice"), _jumps(F.col("at"), reach).alias("jumps"))
    chain = slices.select("__key", table.alias("__table")).groupBy("__key").agg(F.sort_array(F.collect_list("__table")).alias("tables"))
    begin = F.get(F.get("tables", F.lit(0))["jumps"], F.lit(0))["entry"] - reach
    none = F.struct(begin.alias("last"), F.expr("cast(array() as array<struct<slice: bigint, last: bigint>>)").alias("out"))

    def through(acc: Column, t: Column) -> Column:
        """A slice without a position far enough changes nothing."""
        last = F.coalesce(_first(t["jumps"], lambda j: j["entry"] >= acc["last"] + reach)["exit"], acc["last"])
        return F.struct(last.alias("last"), F.concat(acc["out"], F.array(F.struct(t["slice"].alias("slice"), acc["last"].alias("last")))).alias("out"))

    known = chain.select("__key", F.explode(F.aggregate("tables", none, through, lambda acc: acc["out"])).alias("s")).select("__key", F.col("s.slice").alias("__slice"), F.col("s.last").alias("__last"))

    def take(acc: Column, x: Column) -> Column:
        return F.when(x - acc["last"] >= reach, F.struct(x.alias("last"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)

    walked = F.aggregate("at", F.struct(F.col("__last").alias("last"), F.expr("cast(array() as array<bigint>)").alias("out")), take, lambda acc: acc["out"])
    taken = slices.join(known, ["__key", "__slice"]).select("__key", F.explode(walked).alias("__taken"))
    return placed.join(taken, (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__taken")), "left_semi").select(rows.columns)


def cooldown(alerts: DataFrame, seconds: int = COOLDOWN_S) -> DataFrame:
    """Per sensor, alerts whose window ends at least ``seconds`` after the last one that was let through."""
    return spaced(alerts, "sensor_id", F.unix_seconds("window_end"), seconds)


def rising_trends(cells: DataFrame, windows: int = TREND_WINDOWS, least: float = TREND_DELTA) -> DataFrame:
    """Per cell, ``windows`` means in a row that rise strictly, by ``least`` in all; after an alert the next needs as many new ones.  Windows without a mean are skipped."""
    windows = max(2, windows)
    order = Window.partitionBy("geohash").orderBy("window_start")
    rows = cells.where("cpm_avg is not null")
    back = [F.lag("cpm_avg", k).over(order) if k else F.col("cpm_avg") for k in range(windows - 1, -1, -1)]
    rows = rows.select("*", F.row_number().over(order).alias("__row"), F.array(*back).alias("__series"))
    series = F.col("__series")
    steps = [F.get(series, F.lit(k)) < F.get(series, F.lit(k + 1)) for k in range(windows - 1)]
    delta = F.get(series, F.lit(windows - 1)) - F.get(series, F.lit(0))
    ok = delta >= least
    for s in steps:
        ok = ok & s
    found = spaced(rows.where(F.coalesce(ok, F.lit(False))), "geohash", F.col("__row"), windows)
    return found.select(
        F.col("geohash").alias("sensor_id"), F.lit("rising-trend").alias("reason"), "window_start", "window_end", F.col("cpm_max").alias("cpm"), F.lit(windows).alias("breach_count"),
        F.col("centroid_latitude").alias("latitude"), F.col("centroid_longitude").alias("longitude"), X.iso(F.col("window_end")).alias("triggered_at"), "geohash",
        F.struct(F.lit(windows).alias("window_count"), series.alias("cpm_series"), X.round_to(delta, 4).alias("delta")).alias("trend"),
    )


def with_region(alerts: DataFrame, cells: DataFrame, precision: int = 5) -> DataFrame:
    """Adds geohash and hot_region: the newest cell window that ended no later than the alert's; null without one or without a position.

    An as-of join as one ordered pass: cells and alerts of a geohash are sorted
    together, cells first, and each alert looks back to the last cell.
    """
    placed = alerts.withColumn("geohash", X.geohash(F.col("latitude"), F.col("longitude"), precision))
    summary = F.struct(*(F.col(c) for c in ("geohash", "cpm_avg", "cpm_max", "count", "worst_classification", "centroid_latitude", "centroid_longitude")))
    side = cells.select("geohash", F.col("window_end").alias("__t"), F.lit(0).alias("__kind"), summary.alias("__cell"), F.lit(None).cast(placed.schema).alias("__alert"))
    main = placed.where("geohash is not null").select("geohash", F.col("window_end").alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(side.schema["__cell"].dataType).alias("__cell"), F.struct(*placed.columns).alias("__alert"))
    order = Window.partitionBy("geohash").orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = side.union(main).withColumn("__last", F.last("__cell", ignorenulls=True).over(order)).where("__kind = 1")
    joined = seen.select("__alert.*", X.region_summary(F.col("__last")).alias("hot_region"))
    return joined.unionByName(placed.where("geohash is null").withColumn("hot_region", F.lit(None).cast(joined.schema["hot_region"].dataType)))


def all_alerts(*kinds: DataFrame) -> DataFrame:
    """Bag union of alert kinds; fields that a kind lacks are null."""
    out, *rest = kinds
    for other in rest:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
