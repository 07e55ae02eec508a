"""The engine by SQL: temporary views over its operators, and native functions.

    register(spark, events=..., archive=...)
    spark.sql("select * from insight_hotspots(-90, 90, -180, 180, timestamp '2024-01-01', timestamp '2024-02-01', 10)")

Functions are SQL functions, which the optimizer inlines, so filters reach the scan below a view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldstream.functions import expr as X
from fieldstream.operators import alerts as A
from fieldstream.operators import cells as C
from fieldstream.operators import clean as Q
from fieldstream.operators import config_log as G
from fieldstream.operators import ingest as I
from fieldstream.operators import insights as H

SPAN_AND_BOX = "min_lat double, max_lat double, min_lon double, max_lon double, start timestamp, until timestamp"
#: A null bound holds everything; a row without a centroid is in no box.
INSIDE = """(in_box.min_lat is null or (centroid_latitude between in_box.min_lat and in_box.max_lat and centroid_longitude between in_box.min_lon and in_box.max_lon))
  and (in_box.start is null or window_start >= in_box.start) and (in_box.until is null or window_start <= in_box.until)"""
MEAN = "cast(sum(cast(cast(cpm_avg as decimal(18,4)) * cast(case when cpm_avg is not null then count end as decimal(12,0)) as decimal(30,4))) as double) / nullif(sum(count), 0)"
ARCHIVE_COLUMNS = "geohash string, window_start timestamp, window_end timestamp, count bigint, cpm_avg double, cpm_max double, cpm_min double, safe_count bigint, warn_count bigint, danger_count bigint, worst_classification string, centroid_latitude double, centroid_longitude double, rolling_cpm_avg double, cpm_zscore double, anomaly boolean"
NAMES = ", ".join(c.split()[0] for c in ARCHIVE_COLUMNS.split(", "))


def _scalars() -> dict[str, str]:
    """Functions of values: signature and body."""
    return {
        "classify": (f"cpm double, warn double default {X.WARN}, danger double default {X.DANGER}", "string", "case when cpm is null then null when cpm >= danger then 'DANGER' when cpm >= warn then 'WARN' else 'SAFE' end"),
        "severity": ("level string", "int", "case level when 'SAFE' then 1 when 'WARN' then 2 when 'DANGER' then 3 end"),
        "plausible": ("cpm double", "boolean", f"cpm is null or (cpm between 0 and {X.MOST_CPM} and not isnan(cpm))"),
        "distance_m": (
            "lat1 double, lon1 double, lat2 double, lon2 double", "double",
            f"2 * {X.EARTH_M} * asin(sqrt(least(1.0, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
        ),
    }


def _tables() -> dict[str, tuple[str, str, str]]:
    """Functions that return rows of the view ``archive``."""
    inside = lambda name: INSIDE.replace("in_box", name)
    return {
        "archive_within": (SPAN_AND_BOX, ARCHIVE_COLUMNS, f"select {NAMES} from archive where {inside('archive_within')}"),
        "insight_summary": (
            SPAN_AND_BOX, "windows bigint, cells bigint, anomalies bigint, first_window timestamp, last_window timestamp, peak_cpm double",
            f"select count(*), count(distinct geohash), count_if(anomaly), min(window_start), max(window_start), max(cpm_max) from archive where {inside('insight_summary')}",
        ),
        "insight_timeseries": (
            SPAN_AND_BOX, "window_start timestamp, count bigint, cpm_avg double, cpm_max double, danger_count bigint, anomaly_cells bigint, flagged boolean",
            f"select window_start, sum(count), {MEAN}, max(cpm_max), coalesce(sum(danger_count), 0), count_if(anomaly), count_if(anomaly) > 0 from archive where {inside('insight_timeseries')} group by window_start order by window_start desc limit {H.MOST_WINDOWS}",
        ),
        "insight_hotspots": (
            f"{SPAN_AND_BOX}, n int default 10", "geohash string, latitude double, longitude double, peak_cpm double, cpm_avg double, count bigint, windows bigint, anomaly_windows bigint",
            f"""select geohash, latitude, longitude, peak_cpm, cpm_avg, count, windows, anomaly_windows from (
              select *, row_number() over (order by peak_cpm desc nulls last, geohash) as place from (
                select geohash, cast(sum(cast(centroid_latitude as decimal(18,6))) as double) / count(centroid_latitude) as latitude, cast(sum(cast(centroid_longitude as decimal(18,6))) as double) / count(centroid_longitude) as longitude,
                  max(cpm_max) as peak_cpm, {MEAN} as cpm_avg, sum(count) as count, count(*) as windows, count_if(anomaly) as anomaly_windows
                from archive where {inside('insight_hotspots')} group by geohash order by peak_cpm desc nulls last, geohash limit {H.MOST_HOTSPOTS}))
              where place <= insight_hotspots.n""",
        ),
    }


def register(spark: SparkSession, events: DataFrame | None = None, archive: DataFrame | None = None, log: DataFrame | None = None, precision: int = 5, window: str = "60 seconds", spans: tuple[str, str] = ("300 seconds", "60 seconds"), tie: str = "seq") -> list[str]:
    """Make temporary views and functions of a session; their names.

    ``events`` (accepted readings) gives events, classified (by the log of configurations, where there is one), mobility, cells, sustained, trends and
    alerts; ``log`` gives config_versions; ``archive`` gives archive and the functions over it.
    """
    views: dict[str, DataFrame] = {}
    if log is not None:
        views["config_versions"] = G.versions(log)
    if events is not None:
        classified = G.classify_as_of(events, views["config_versions"]) if log is not None else Q.with_class(events)
        cells = C.rolling(C.cell_windows(classified, precision, window))
        sustained = A.with_region(A.cooldown(A.sustained_high(classified, *spans, tie=tie)), cells, precision)
        trends = A.rising_trends(cells)
        views |= {"events": events, "classified": classified, "mobility": I.tag_mobility(events, [tie]), "cells": cells, "sustained": sustained, "trends": trends, "alerts": A.all_alerts(sustained, trends)}
    if archive is not None:
        views["archive"] = archive
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    made = dict(_scalars())
    for name, (takes, gives, body) in made.items():
        spark.sql(f"create or replace temporary function {name}({takes}) returns {gives} return {body}")
    if archive is not None:
        for name, (takes, gives, body) in _tables().items():
            spark.sql(f"create or replace temporary function {name}({takes}) returns table ({gives}) return {body}")
            made[name] = (takes, gives, body)
    return [*views, *made]
