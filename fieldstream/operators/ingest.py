"""From raw text rows to events, and the mobility tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.functions import expr as X

#: Metres that a sensor's box must span to count as mobile.
MOBILE_M = 200.0
# Named spans to fill in later.
PRESETS = {"fukushima": ("2011-03-11T00:00:00", "2011-04-30T23:59:59")}


def row_md5(columns: list[str]) -> Column:
    """Checksum of ``name=value`` pairs in the order of the names; a missing value is empty."""
    return F.md5(F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit(""))) for c in sorted(columns))))


def map_rows(rows: DataFrame) -> DataFrame:
    """Raw rows (all text) to events with ``reject_reason``: null, or why the row is no event.

    A row needs a sensor, a time and a position in range.  Without uploaded_at the
    time of capture takes its place; a value counts only with a known unit.
    """
    have = set(rows.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    unit = X.checked_unit(text("unit"))
    # each text is parsed once: what is used more often has a column of its own first
    parsed = rows.select(
        X.sensor_of(text("sensor_id"), text("device_id")).alias("sensor_id"), X.normal_time(text("captured_at")).alias("captured_at"), X.normal_time(text("uploaded_at")).alias("uploaded_at"),
        X.number(text("latitude")).alias("latitude"), X.number(text("longitude")).alias("longitude"), F.when(unit.isNotNull(), X.number(text("value"))).alias("cpm"), unit.alias("unit"),
        X.blank_to_null(text("location_name")).alias("location_name"), X.blank_to_null(text("surface")).alias("surface"), X.blank_to_null(text("measurement_import_id")).alias("loader_id"), X.number(text("height")).alias("height"),
        F.coalesce(X.blank_to_null(text("md5sum")), row_md5(rows.columns)).alias("md5sum"),
    )
    reason = F.when(F.col("sensor_id").isNull(), "no sensor").when(F.col("captured_at").isNull(), "no time").when(~X.valid_position(F.col("latitude"), F.col("longitude")), "no position")
    return parsed.select(
        "sensor_id", "captured_at", F.coalesce("uploaded_at", "captured_at").alias("uploaded_at"), "latitude", "longitude", F.when(~F.isnan("cpm"), F.col("cpm")).alias("cpm"), "unit", "location_name", "surface", "loader_id", "height", "md5sum", reason.alias("reject_reason"),
    )


def backfill(events: DataFrame, start: str | None = None, end: str | None = None, preset: str | None = None) -> DataFrame:
    """Events captured in [start, end], or in a preset's span where a bound isn't given; those without a time stay."""
    if preset:
        start, end = start or PRESETS[preset][0], end or PRESETS[preset][1]
    return events.where(X.in_backfill(X.timestamp(F.col("captured_at").cast("string")), start, end))


#: The sides of a box: south-west and north-east.
SIDES = {"__south": (F.min, "latitude"), "__west": (F.min, "longitude"), "__north": (F.max, "latitude"), "__east": (F.max, "longitude")}


def _with_earlier(rows: DataFrame, found: dict) -> DataFrame:
    """Adds for each name the least or greatest value of a column over the sensor's earlier slices; one row for each slice of a sensor meets in one task."""
    per = rows.groupBy(F.col("sensor_id").alias("__sensor"), F.col("__slice").alias("__part")).agg(*(f(c).alias(n) for n, (f, c) in found.items()))
    earlier = Window.partitionBy("__sensor").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("__sensor", "__part", *(f(n).over(earlier).alias(n) for n, (f, _) in found.items()))
    same = F.col("sensor_id").eqNullSafe(F.col("__sensor")) & F.col("__slice").eqNullSafe(F.col("__part"))
    return rows.join(carried, same, "left").drop("__sensor", "__part")


def tag_mobility(events: DataFrame, order: list[str], least_m: float = MOBILE_M, slices: Column | None = None) -> DataFrame:
    """Adds sensor_type: mobile from the reading on whose box of positions so far spans over ``least_m`` metres, else fixed.

    The flag is kept, not the span: near a pole a growing box can get a shorter diagonal.
    ``slices`` never falls as ``order`` rises; with it each slice of a sensor is sorted on its own, with the box and the flag that the
    slices before it leave, so a sensor with a large share of all rows is spread over tasks.
    """
    if least_m <= 0:
        raise ValueError("the least distance must be positive")
    sliced = events.withColumn("__slice", F.lit(0) if slices is None else slices)
    so_far = Window.partitionBy("sensor_id", "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    box, flag = [f(c).over(so_far) for f, c in SIDES.values()], F.max("__far").over(so_far)
    if slices is not None:
        sliced = _with_earlier(sliced, SIDES)
        wider = {F.min: F.least, F.max: F.greatest}
        box, flag = [wider[f](own, F.col(n)) for own, (n, (f, _)) in zip(box, SIDES.items())], F.greatest(flag, F.col("__was"))
    boxed = sliced.withColumn("__far", X.haversine_m(*box) > least_m)
    if slices is not None:
        boxed = _with_earlier(boxed, {"__was": (F.max, "__far")})
    return boxed.withColumn("sensor_type", F.when(flag, "mobile").otherwise("fixed")).drop("__far", "__was", "__slice", *SIDES)


def fleet_counts(tagged: DataFrame) -> DataFrame:
    """Sensors seen, and how many of them were ever mobile."""
    per = tagged.groupBy("sensor_id").agg(F.bool_or(F.col("sensor_type") == "mobile").alias("mobile"))
    return per.agg(F.count("*").alias("sensors_seen"), F.coalesce(F.sum(F.col("mobile").cast("long")), F.lit(0).cast("long")).alias("mobile_count"))
