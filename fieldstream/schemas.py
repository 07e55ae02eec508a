"""Schemas of the messages and tables."""

from pyspark.sql import types as T

S, D, L, I, B, TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()  # noqa: E741


def _of(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: A reading on the wire; numbers and times are read as text and cast, so bad values become null instead of failing.
RAW_EVENT = _of(
    sensor_id=S, captured_at=S, uploaded_at=S, latitude=S, longitude=S, cpm=S, unit=S, classification=S, sensor_type=S, location_name=S, surface=S, loader_id=S, height=S, md5sum=S
)
EVENT = _of(
    sensor_id=S, captured_at=TS, uploaded_at=TS, latitude=D, longitude=D, cpm=D, unit=S, classification=S, sensor_type=S, location_name=S, surface=S, loader_id=S, height=D, md5sum=S
)
CLASS_COUNTS = _of(SAFE=L, WARN=L, DANGER=L)
CELL = _of(
    geohash=S, precision=I, window_start=TS, window_end=TS, count=L, cpm_avg=D, cpm_max=D, cpm_min=D, class_counts=CLASS_COUNTS, worst_classification=S,
    centroid_latitude=D, centroid_longitude=D, rolling_cpm_avg=D, cpm_zscore=D, anomaly=B,
)
HOT_REGION = _of(cpm_avg=D, cpm_max=D, count=L, worst_classification=S, centroid_latitude=D, centroid_longitude=D)
TREND = _of(window_count=I, cpm_series=T.ArrayType(D), delta=D)
ALERT = _of(
    sensor_id=S, reason=S, window_start=TS, window_end=TS, cpm=D, breach_count=I, classification=S, latitude=D, longitude=D, triggered_at=S, geohash=S, hot_region=HOT_REGION, trend=TREND
)
AREA = _of(min_lat=D, max_lat=D, min_lon=D, max_lon=D)
SPAN = _of(start=TS, end=TS)
CONFIG = _of(cpm_warn_threshold=D, cpm_danger_threshold=D, area=AREA, timespan=SPAN)
ARCHIVE = _of(
    geohash=S, precision=I, window_start=TS, window_end=TS, count=L, cpm_avg=D, cpm_max=D, cpm_min=D, safe_count=L, warn_count=L, danger_count=L, worst_classification=S,
    centroid_latitude=D, centroid_longitude=D, rolling_cpm_avg=D, cpm_zscore=D, anomaly=B,
)
#: Columns of a log of configurations.
LOG = {"version": L, "effective_at": TS, "warn": D, "danger": D, "area": AREA, "timespan": SPAN}
