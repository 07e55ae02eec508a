"""The registered queries over readings, with DuckDB SQL for each.

Windows are days here, as the test table has about two readings per sensor and
day; the operators' defaults are those of a live stream.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstream import catalog
from fieldstream.functions import expr as X
from fieldstream.operators import alerts as A
from fieldstream.operators import cells as C
from fieldstream.operators import clean as Q
from fieldstream.operators import config_log as G
from fieldstream.operators import ingest as I
from fieldstream.operators import insights as H
from fieldstream.operators import views as V
from fieldstream.sources import tables as S
from fieldstream.sources.archive import Archive
from fieldstream.sources.readings import READINGS_SQL, readings

PRECISION, COOLDOWN_S = 2, 3 * 86_400
TIE = ["uploaded_at", "seq"]
# texts that are no numbers but for the last four, and blanks of several kinds
ODD_NUMBERS = ("5d", "5f", "0x1p3", "1__0", "1_0", "\t7.5\u00a0", "+.5e1", "8.")
BLANK = "\t\x1f\u2003"
# texts that are no times, and one that is
ODD_TIMES = ("12:30", "2024", "2024-01", "2024-01-01 5:3", "2024-01-01T05:03:00 Europe/Paris", "2024-01-01T05:03:04.1234567+09:00")
VIEW = V.View(H.Box(-40.0, 50.0, -120.0, 120.0), "2024-01-05", "2024-01-20 12:00:00")


def flat(df: DataFrame) -> DataFrame:
    """Structs as columns of their own, times as text, arrays as joined text: plain values that any engine compares alike."""
    out = []
    for f in df.schema.fields:
        inner = [(F.col(f"{f.name}.{x.name}"), f"{f.name}_{x.name}", x.dataType) for x in f.dataType.fields] if isinstance(f.dataType, T.StructType) else [(F.col(f.name), f.name, f.dataType)]
        for c, name, kind in inner:
            if isinstance(kind, T.TimestampType):
                c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
            elif isinstance(kind, T.ArrayType):
                c = F.array_join(F.transform(c, lambda x: F.floor(x * 10_000 + 0.5).cast("string")), ",")
            out.append(c.alias(name))
    return df.select(*out)


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a known unit and a plausible count, repeats left out."""
    gated = readings(spark, sf_dir).withColumn("cpm", F.when(X.checked_unit(F.col("unit")).isNotNull(), F.col("cpm")))
    return Q.first_of_repeats(Q.plausible(Q.with_value(gated)), TIE)


def classed(spark, sf_dir):
    return Q.with_class(accepted(spark, sf_dir))


def day_cells(spark, sf_dir):
    return C.cell_windows(classed(spark, sf_dir), PRECISION, "1 day")


def scored(spark, sf_dir):
    return C.rolling(day_cells(spark, sf_dir))


def high(spark, sf_dir):
    return A.sustained_high(classed(spark, sf_dir), "5 days", "1 day")


def archive(spark, sf_dir):
    """Two batches of archive rows: without and with the readings that were sent again."""
    once = S.archive_rows(scored(spark, sf_dir)).withColumn("batch_id", F.lit(0))
    late = S.archive_rows(C.rolling(C.cell_windows(Q.with_class(Q.plausible(Q.with_value(readings(spark, sf_dir)))), PRECISION, "1 day"))).where("window_start >= '2024-01-10'").withColumn("batch_id", F.lit(1))
    return once.unionByName(late)


def raw_rows(spark, sf_dir):
    """Readings as rows of text, the way a file has them, with what goes wrong in files."""
    r, k = readings(spark, sf_dir), F.col("seq")
    odd = F.get(F.array(*map(F.lit, ODD_NUMBERS)), F.floor(k / 31).cast("int") % len(ODD_NUMBERS))
    return r.select(
        F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"), F.when(k % 11 == 0, "").otherwise(F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("uploaded_at"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, " ").otherwise(BLANK)).otherwise(F.col("sensor_id")).alias("sensor_id"), F.when(k % 15 == 0, "0").otherwise(F.concat(F.lit("d"), "sensor_id")).alias("device_id"),
        F.when(k % 23 == 0, "north").when(k % 29 == 0, "95.5").otherwise(F.col("latitude").cast("string")).alias("latitude"), F.col("longitude").cast("string").alias("longitude"),
        F.when(k % 13 == 0, "n/a").when(k % 31 == 0, odd).otherwise(F.col("cpm").cast("string")).alias("value"), F.concat(F.col("unit"), F.when(k % 5 == 0, BLANK).otherwise(" ")).alias("unit"), F.when(k % 7 == 0, "").otherwise(F.col("md5sum")).alias("md5sum"),
    )


def csv_map_events(spark, sf_dir):
    rows = I.map_rows(raw_rows(spark, sf_dir))
    return rows.select("sensor_id", "captured_at", "uploaded_at", "latitude", "longitude", "cpm", "unit", "reject_reason", "md5sum")


def csv_scan(spark, sf_dir):
    """The same rows written as CSV files with the headers of a provider, scanned, and mapped to events."""
    path = f"{S.scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    heads = {"captured_at": " Captured Time", "uploaded_at": "Uploaded Time", "device_id": "Device ID", "value": "Value ", "md5sum": "MD5Sum"}
    raw = raw_rows(spark, sf_dir)
    named = raw.select(*(F.col(c).alias(heads.get(c, c.title())) for c in raw.columns), F.lit("x").alias("Other"))
    named.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    rows = I.map_rows(S.read_csv(spark, path))
    return rows.select("sensor_id", "captured_at", "uploaded_at", "latitude", "longitude", "cpm", "unit", "reject_reason", "md5sum")


def backfill_spans(spark, sf_dir):
    """How many events a span, one open to a side, and a preset with one bound of its own let through."""
    events = I.map_rows(raw_rows(spark, sf_dir)).where("reject_reason is null")
    cases = {"both": dict(start="2024-01-05T06:00:00", end="2024-01-20 12:00:00"), "from": dict(start="2024-01-25T00:00:00Z"), "until": dict(end="2024-01-02T00:00:00"), "preset": dict(preset="fukushima"), "preset_open": dict(preset="fukushima", end="2024-01-03T00:00:00")}
    ends = (F.count("*").alias("events"), F.min("captured_at").alias("first"), F.max("captured_at").alias("last"))
    return reduce(DataFrame.union, (I.backfill(events, **span).agg(*ends).select(F.lit(name).alias("span"), "events", "first", "last") for name, span in cases.items()))


def messages(spark, sf_dir):
    """Readings as JSON messages, some of which break the contract."""
    r, k = readings(spark, sf_dir), F.col("seq")
    odd = F.get(F.array(*map(F.lit, ODD_TIMES)), F.floor(k / 11).cast("int") % len(ODD_TIMES))
    fields = [
        F.when(k % 19 == 0, "").otherwise(F.col("sensor_id")).alias("sensor_id"), F.when(k % 11 == 0, odd).otherwise(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("captured_at"), F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("uploaded_at"),
        F.when(k % 23 == 0, F.lit(200.0)).otherwise(F.col("latitude")).alias("latitude"), "longitude", "unit", F.when(k % 59 == 0, "never").otherwise("SAFE").alias("classification"),
    ]
    number = F.when(k % 31 == 0, -5.0).when(k % 37 == 0, 9_999_999.0).otherwise(F.col("cpm"))
    odd = S.to_json(*fields, F.when(k % 29 == 0, F.when(k % 2 == 0, "x").otherwise("5d")).otherwise("7").alias("cpm"))  # the last is a number sent as text
    more = S.to_json(*fields, number.alias("cpm"), F.lit(1).alias("unknown"))
    value = F.when(k % 41 == 0, "null").when(k % 43 == 0, "[1]").when((k % 29 == 0) | (k % 47 == 0), odd).when(k % 53 == 0, more).otherwise(S.to_json(*fields, number.alias("cpm")))
    return r.select("seq", value.alias("value"))


def validate_reasons(spark, sf_dir):
    judged = Q.decode(messages(spark, sf_dir)).select("seq", F.coalesce(Q.discard_reason(F.col("event"), F.col("value")), F.lit("valid")).alias("reason"))
    return judged.groupBy("reason").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.sum("seq").alias("sum_seq"))


def clean_filters(spark, sf_dir):
    return Q.plausible(Q.with_value(readings(spark, sf_dir))).select("seq", "sensor_id", "cpm", "unit")


def dedup_first(spark, sf_dir):
    return flat(Q.first_of_repeats(readings(spark, sf_dir), TIE).select("seq", "sensor_id", "md5sum", "uploaded_at"))


def classify_levels(spark, sf_dir):
    return Q.with_class(readings(spark, sf_dir)).select("seq", "cpm", "classification", F.coalesce(X.severity(F.col("classification")), F.lit(0)).alias("severity"))


def config_updates(spark, sf_dir):
    """A log of partial updates: one for each 400th event, some of them invalid."""
    e = readings(spark, sf_dir).where("seq % 400 = 7").groupBy("seq").agg(F.min("captured_at").alias("effective_at"))
    k = F.floor(F.col("seq") / 400)
    area = F.when(k % 3 == 1, F.struct(F.lit(-60.0).alias("min_lat"), (k % 7 * 10.0).alias("max_lat"), F.lit(-170.0).alias("min_lon"), F.when(k % 9 == 4, -180.0).otherwise(120.0).alias("max_lon")))
    span = F.when(k % 4 == 2, F.struct(F.lit("2024-01-03").cast("timestamp").alias("start"), F.date_add(F.lit("2024-01-12").cast("date"), (k % 15).cast("int")).cast("timestamp").alias("end")))
    return e.select(F.col("seq").alias("version"), "effective_at", F.when(k % 2 == 0, 50.0 + k % 5 * 25).alias("warn"), F.when(k % 5 < 3, k % 6 * 300.0 - 200.0).alias("danger"), area.alias("area"), span.alias("timespan"))


def ordered_log(spark, sf_dir):
    """Updates in the order of their time, which also numbers the versions."""
    return config_updates(spark, sf_dir).withColumn("version", F.unix_seconds("effective_at") * 1_000_000 + F.col("version"))


def config_fold(spark, sf_dir):
    return flat(G.versions(ordered_log(spark, sf_dir)))


def classify_asof_config(spark, sf_dir):
    return G.classify_as_of(accepted(spark, sf_dir), G.versions(ordered_log(spark, sf_dir))).select("seq", "cpm", F.coalesce("config.version", F.lit(0)).alias("version"), "classification")


def region_filter(spark, sf_dir):
    joined = G.as_of(accepted(spark, sf_dir), G.versions(ordered_log(spark, sf_dir)))
    return joined.where(G.in_region(F.col("config"), F.col("latitude"), F.col("longitude"), F.col("captured_at"))).select("seq", "sensor_id", "latitude", "longitude")


def geohash_cells(spark, sf_dir):
    r = readings(spark, sf_dir)
    return r.select("seq", *(X.geohash(F.col("latitude"), F.col("longitude"), p).alias(f"geohash{p}") for p in (2, 5, 7)))


def cell_windows(spark, sf_dir):
    return flat(day_cells(spark, sf_dir))


def worst_class(spark, sf_dir):
    rows = classed(spark, sf_dir).groupBy("sensor_id").agg(F.max(X.severity(F.col("classification"))).alias("s"), F.count("*").alias("readings"))
    return rows.select("sensor_id", X.level_name(F.col("s")).alias("worst_classification"), "readings")


def rolling_zscore(spark, sf_dir):
    return flat(scored(spark, sf_dir).select("geohash", "window_start", "cpm_avg", "rolling_cpm_avg", "cpm_zscore", "anomaly"))


def sustained_high(spark, sf_dir):
    return flat(high(spark, sf_dir))


def alert_cooldown(spark, sf_dir):
    return flat(A.cooldown(high(spark, sf_dir), COOLDOWN_S).select("sensor_id", "window_start", "window_end", "cpm", "breach_count"))


def rising_trend(spark, sf_dir):
    return flat(A.rising_trends(scored(spark, sf_dir)))


def alert_hot_region(spark, sf_dir):
    alerts = A.cooldown(high(spark, sf_dir), COOLDOWN_S)
    return flat(A.with_region(alerts, day_cells(spark, sf_dir), PRECISION).select("sensor_id", "window_end", "cpm", "geohash", "hot_region")).withColumn("hot_region_count", F.coalesce("hot_region_count", F.lit(0).cast("long")))


def both_kinds(spark, sf_dir):
    alerts = A.with_region(A.cooldown(high(spark, sf_dir), COOLDOWN_S), day_cells(spark, sf_dir), PRECISION)
    return A.all_alerts(alerts, A.rising_trends(scored(spark, sf_dir)))


def alerts_union(spark, sf_dir):
    return flat(both_kinds(spark, sf_dir).select("sensor_id", "reason", "window_start", "window_end", "cpm", "breach_count", "classification", "geohash"))


def tagged(spark, sf_dir):
    return I.tag_mobility(readings(spark, sf_dir), ["seq", "uploaded_at"], slices=F.floor(F.col("seq") / 100_000))


def mobility_tag(spark, sf_dir):
    return flat(tagged(spark, sf_dir).select("seq", "sensor_id", "uploaded_at", "sensor_type"))


def fleet_counts(spark, sf_dir):
    return I.fleet_counts(tagged(spark, sf_dir))


def archive_latest(spark, sf_dir):
    return flat(S.latest_rows(archive(spark, sf_dir)).select("geohash", "window_start", "count", "cpm_avg", "danger_count", "batch_id"))


def insight_summary(spark, sf_dir):
    return flat(H.summary(S.latest_rows(archive(spark, sf_dir))))


def insight_timeseries(spark, sf_dir):
    rows = H.within(S.latest_rows(archive(spark, sf_dir)), VIEW.box, VIEW.start, VIEW.end)
    return flat(H.trend_points(H.timeseries(rows)).withColumn("cpm_avg", X.round_to(F.col("cpm_avg"), 4)))


def insight_hotspots(spark, sf_dir):
    top = H.hotspots(S.latest_rows(archive(spark, sf_dir)), 10)
    return top.select("geohash", *(X.round_to(F.col(c), 4).alias(c) for c in ("latitude", "longitude", "cpm_avg", "share")), "peak_cpm", "count", "windows", "anomaly_windows")


def stored_archive(spark, sf_dir) -> Archive:
    """An archive in the shared folder that got two batches, after which one day was compacted."""
    stored = Archive(spark, f"{S.scratch_dir(spark)}/archive-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(stored.path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    batches = archive(spark, sf_dir)
    for k in (0, 1):
        stored.append(batches.where(F.col("batch_id") == k).drop("batch_id"), k)
    stored.compact(["2024-01-12"])
    return stored


def archive_timeseries(spark, sf_dir):
    """As insight_timeseries, from the folders of the span in a stored archive."""
    rows = H.within(stored_archive(spark, sf_dir).read(VIEW.start, VIEW.end), VIEW.box, VIEW.start, VIEW.end)
    return flat(H.trend_points(H.timeseries(rows)).withColumn("cpm_avg", X.round_to(F.col("cpm_avg"), 4)))


def archive_anomalies(spark, sf_dir):
    """The anomalies of a stored archive, from its side table."""
    return flat(stored_archive(spark, sf_dir).anomalies(VIEW.start, VIEW.end).select("geohash", "window_start", "count", "cpm_avg", "cpm_zscore"))


def sql_hotspots(spark, sf_dir):
    """Hotspots by SQL alone, in a box and a span."""
    catalog.register(spark, archive=S.latest_rows(archive(spark, sf_dir)))
    top = spark.sql(f"select * from insight_hotspots(-40, 50, -120, 120, timestamp '{VIEW.start}', timestamp '{VIEW.end}', 20)")
    return top.select("geohash", *(X.round_to(F.col(c), 4).alias(c) for c in ("latitude", "longitude", "cpm_avg")), "peak_cpm", "count", "windows", "anomaly_windows")


def sql_alert_levels(spark, sf_dir):
    """Alerts of both kinds by reason and level, by SQL over the registered views."""
    catalog.register(spark, events=accepted(spark, sf_dir), precision=PRECISION, window="1 day", spans=("5 days", "1 day"))
    return spark.sql("select reason, classify(cpm) as level, severity(classify(cpm)) as rank, count(*) as alerts, max(cpm) as peak from sustained group by all union all select reason, classify(cpm), severity(classify(cpm)), count(*), max(cpm) from trends group by all")


def density_histogram(spark, sf_dir):
    return H.density(accepted(spark, sf_dir))


def latest_per_sensor(spark, sf_dir):
    return flat(V.latest(readings(spark, sf_dir), ["sensor_id"], ["seq", "uploaded_at"]).select("sensor_id", "seq", "uploaded_at", "cpm"))


def recent_page(spark, sf_dir):
    rows = accepted(spark, sf_dir)
    top = rows.agg((F.max("seq") - 20).alias("cursor"))  # one row
    return V.page(rows.crossJoin(F.broadcast(top)), F.col("cursor"), 25).select("seq", "sensor_id", "cpm", "has_more", "next_cursor")


def view_filter_failopen(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("latitude", F.when(F.col("seq") % 27 != 0, F.col("latitude"))).withColumn("captured_at", F.when(F.col("seq") % 35 != 0, F.col("captured_at")))
    return V.seen(rows, VIEW).select("seq", "sensor_id", "latitude", "cpm")


def view_recolor(spark, sf_dir):
    return V.recolour(classed(spark, sf_dir), 250.0, 1500.0).select("seq", "classification", "shown_class")


def alert_log_newest(spark, sf_dir):
    return flat(V.alert_log(both_kinds(spark, sf_dir)).select("sensor_id", "reason", "window_start", "window_end", "cpm"))


def newest_by_key(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("day", F.date_format("captured_at", "yyyy-MM-dd"))
    return V.newest_of_key(rows, ["sensor_id", "day"]).select("sensor_id", "day", "seq")


def delivery_order(spark, sf_dir):
    rows = classed(spark, sf_dir)
    return V.delivery(rows.where("classification = 'DANGER'"), rows, "sensor_id").select("lane", "seq", "sensor_id", "cpm")


def json_round_trip(spark, sf_dir):
    """Readings published as keyed JSON and parsed again."""
    r = readings(spark, sf_dir)
    back = Q.parse(S.keyed(r.select("sensor_id", "captured_at", "uploaded_at", "latitude", "longitude", "cpm", F.when(F.col("unit") == "cpm", F.col("unit")).alias("unit"), "md5sum")))
    return back.groupBy("sensor_id").agg(F.count("*").alias("readings"), F.count("unit").alias("with_unit"), F.count("cpm").alias("with_value"), F.max("cpm").alias("peak"), F.count_distinct("md5sum").alias("distinct_md5"), F.date_format(F.max("captured_at"), "yyyy-MM-dd HH:mm:ss").alias("last_captured"))


# --- the same in SQL ---

UNITS_SQL = ", ".join(f"'{u}'" for u in X.UNITS)


def class_sql(cpm: str, warn: str = "100", danger: str = "1000") -> str:
    return f"case when {cpm} is null then null when {cpm} >= {danger} then 'DANGER' when {cpm} >= {warn} then 'WARN' else 'SAFE' end"


def round_sql(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10**digits}::double + 0.5) / {10**digits}::double"


def geohash_sql(lat: str, lon: str, precision: int) -> str:
    bx, by = (5 * precision + 1) // 2, 5 * precision // 2
    index = lambda c, low, span, bits: f"least(greatest(ceil(({c} - ({low})) / {span}::double * {1 << bits}::double) - 1, 0), {(1 << bits) - 1})::bigint"
    x, y = index(lon, -180, 360, bx), index(lat, -90, 180, by)
    letters = []
    for k in range(precision):
        bits = [f"((({x} >> {bx - 1 - b // 2}) & 1) << {4 - b % 5})" if b % 2 == 0 else f"((({y} >> {by - 1 - b // 2}) & 1) << {4 - b % 5})" for b in range(5 * k, 5 * k + 5)]
        letters.append(f"substr('{X.BASE32}', ({' + '.join(bits)} + 1)::int, 1)")
    return " || ".join(letters)


def text_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


ACCEPTED_SQL = f"""
, accepted as (select * exclude (rn) from (select *, row_number() over (partition by sensor_id, md5sum order by uploaded_at, seq) as rn from readings
    where unit in ({UNITS_SQL}) and cpm is not null and cpm between 0 and 1000000) where rn = 1),
classed as (select *, {class_sql("cpm")} as classification from accepted)
"""


def cells_of(source: str, name: str) -> str:
    return f"""
, {name}_placed as (select *, {geohash_sql("latitude", "longitude", PRECISION)} as geohash, date_trunc('day', captured_at) as window_start from {source}),
{name} as (select geohash, {PRECISION} as precision, window_start::timestamp as window_start, window_start::timestamp + interval 1 day as window_end, count(*) as count,
    {round_sql("sum(cpm::decimal(18,4))::double / count(cpm)")} as cpm_avg, max(cpm) as cpm_max, min(cpm) as cpm_min,
    count(*) filter (classification = 'SAFE') as class_counts_SAFE, count(*) filter (classification = 'WARN') as class_counts_WARN, count(*) filter (classification = 'DANGER') as class_counts_DANGER,
    case max(case classification when 'SAFE' then 1 when 'WARN' then 2 when 'DANGER' then 3 end) when 1 then 'SAFE' when 2 then 'WARN' when 3 then 'DANGER' end as worst_classification,
    {round_sql("sum(latitude::decimal(18,6))::double / count(latitude)", 6)} as centroid_latitude, {round_sql("sum(longitude::decimal(18,6))::double / count(longitude)", 6)} as centroid_longitude
  from {name}_placed group by geohash, window_start),
{name}_x as (select *, round(cpm_avg * 10000)::hugeint as x from {name}),
{name}_s as (select *, count(x) over p as n, sum(x) over p as s, sum(x * x) over p as q, {round_sql("(sum(x) over r)::double / count(x) over r / 10000")} as rolling_cpm_avg from {name}_x
  window p as (partition by geohash order by window_start rows between 6 preceding and 1 preceding), r as (partition by geohash order by window_start rows between 6 preceding and current row)),
{name}_scored as (select *, coalesce(abs(cpm_zscore) >= 3, false) as anomaly from (select * exclude (x, n, s, q),
    case when n >= 2 and n * q - s * s > 0 then {round_sql("(n * x - s)::double / sqrt((n * q - s * s)::double)")} end as cpm_zscore from {name}_s))
"""


CELLS_SQL = cells_of("classed", "cells")
HIGH_SQL = """
, high_rows as (select *, date_trunc('day', captured_at)::timestamp - to_days(k::int) as window_start from classed, (select unnest(range(5)) as k) where classification = 'DANGER'),
high as (select sensor_id, window_start, window_start + interval 5 day as window_end, max(cpm) as cpm, count(*)::int as breach_count,
    arg_max(latitude, (captured_at, -seq)) as latitude, arg_max(longitude, (captured_at, -seq)) as longitude, max(captured_at)::varchar as triggered_at from high_rows group by sensor_id, window_start having count(*) >= 3)
"""
COOL_SQL = f"""
, recursive_cool as (select sensor_id, min(window_end) as window_end from high group by sensor_id
  union all
  select c.sensor_id, (select min(h.window_end) from high h where h.sensor_id = c.sensor_id and epoch(h.window_end) - epoch(c.window_end) >= {COOLDOWN_S}) from recursive_cool c where c.window_end is not null),
cool as (select h.* from high h join recursive_cool c on h.sensor_id = c.sensor_id and h.window_end = c.window_end)
"""
COOL_600_SQL = COOL_SQL.replace(str(COOLDOWN_S), str(A.COOLDOWN_S))
TREND_SQL = """
, series as (select *, row_number() over o as row_n, lag(cpm_avg, 2) over o as a, lag(cpm_avg, 1) over o as b from cells where cpm_avg is not null window o as (partition by geohash order by window_start)),
rising as (select * from series where a < b and b < cpm_avg and cpm_avg - a >= 5.0),
recursive_rise as (select geohash, min(row_n) as row_n from rising group by geohash
  union all select c.geohash, (select min(r.row_n) from rising r where r.geohash = c.geohash and r.row_n - c.row_n >= 3) from recursive_rise c where c.row_n is not null),
trend as (select r.* from rising r join recursive_rise c on r.geohash = c.geohash and r.row_n = c.row_n)
"""
ARCHIVE_SQL = (
    f", again as (select *, {class_sql('cpm')} as classification from readings where cpm is not null and cpm between 0 and 1000000)"
    + cells_of("again", "late")
    + """
, archive as (select * exclude (rn) from (select *, row_number() over (partition by geohash, window_start order by batch_id desc) as rn from (
    select *, 0 as batch_id from cells_scored union all select *, 1 as batch_id from late_scored where window_start >= timestamp '2024-01-10')) where rn = 1)
"""
)
LOG_SQL = """
, updates as (select epoch_us(effective_at) // 1000000 * 1000000 + seq as version, effective_at, k, case when k % 2 = 0 then 50.0::double + k % 5 * 25 end as warn, case when k % 5 < 3 then k % 6 * 300.0::double - 200.0 end as danger,
    k % 3 = 1 as has_area, (k % 7 * 10)::double as max_lat, case when k % 9 = 4 then -180.0::double else 120.0 end as max_lon, k % 4 = 2 as has_span, date '2024-01-12' + (k % 15)::int as span_end
  from (select seq, min(captured_at) as effective_at, seq // 400 as k from readings where seq % 400 = 7 group by seq)),
numbered as (select *, row_number() over (order by version) as n from updates),
recursive_fold as (
  select 0::bigint as n, 0::bigint as version, null::timestamp as effective_at, 100.0::double as warn, 1000.0::double as danger, null::double as max_lat, null::double as max_lon, null::date as span_end, false as ok
  union all
  select u.n, u.version, u.effective_at, case when good then w else f.warn end, case when good then d else f.danger end, case when good then la else f.max_lat end, case when good then lo else f.max_lon end, case when good then se else f.span_end end, good
  from recursive_fold f join numbered u on u.n = f.n + 1,
  lateral (select coalesce(u.warn, f.warn) as w, coalesce(u.danger, f.danger) as d, case when u.has_area then u.max_lat else f.max_lat end as la, case when u.has_area then u.max_lon else f.max_lon end as lo, case when u.has_span then u.span_end else f.span_end end as se) m,
  lateral (select w > 0 and d > 0 and w < d and (la is null or (-60 < la and -170 < lo)) as good) g),
versions as (select * from recursive_fold where ok)
"""
ASOF_SQL = LOG_SQL + ", latest as (select * from versions where version in (select max(version) from versions group by effective_at)), joined as (select a.*, v.version, v.warn, v.danger, v.max_lat, v.max_lon, v.span_end, v.version is not null as has_config from accepted a asof left join latest v on a.captured_at >= v.effective_at)"


def sql(*parts: str, recursive: bool = False) -> str:
    *ctes, last = parts
    return f"with {'recursive ' if recursive else ''}{READINGS_SQL}{''.join(ctes)}\n{last}"


CELL_COLUMNS = f"geohash, precision::int as precision, {text_sql('window_start')} as window_start, {text_sql('window_end')} as window_end, count, cpm_avg, cpm_max, cpm_min, class_counts_SAFE, class_counts_WARN, class_counts_DANGER, worst_classification, centroid_latitude, centroid_longitude"
REGION = ("cpm_avg", "cpm_max", "count", "worst_classification", "centroid_latitude", "centroid_longitude")
UNION_SQL = f"""
, both_kinds as (select sensor_id, 'sustained-high' as reason, window_start, window_end, cpm, breach_count, 'DANGER' as classification, {geohash_sql("latitude", "longitude", PRECISION)} as geohash from cool
  union all select geohash, 'rising-trend', window_start, window_end, cpm_max, 3, null, geohash from trend)
"""
WEIGHTED = "sum((cpm_avg::decimal(18,4) * case when cpm_avg is not null then count end::decimal(12,0))::decimal(30,4))::double / nullif(sum(count), 0)"
IN_VIEW = "centroid_latitude between -40 and 50 and centroid_longitude between -120 and 120 and window_start between timestamp '2024-01-05' and timestamp '2024-01-20 12:00:00'"

ODD_SQL = "[" + ", ".join(f"'{x}'" for x in ODD_NUMBERS) + f"][seq // 31 % {len(ODD_NUMBERS)} + 1]"
MAPPED_SQL = f"""
, raw as (select seq, captured_at as o_captured, uploaded_at as o_uploaded, sensor_id as o_sensor, latitude as o_latitude, longitude as o_longitude, cpm, unit as o_unit, strftime(captured_at, '%Y-%m-%d %H:%M:%S') as captured_at, case when seq % 11 = 0 then '' else strftime(uploaded_at, '%Y-%m-%dT%H:%M:%SZ') end as uploaded_at, case when seq % 6 = 0 then ' ' when seq % 3 = 0 then '{BLANK}' else sensor_id end as sensor_id,
    case when seq % 15 = 0 then '0' else 'd' || sensor_id end as device_id, case when seq % 23 = 0 then 'north' when seq % 29 = 0 then '95.5' else latitude::varchar end as latitude, longitude::varchar as longitude,
    coalesce(case when seq % 13 = 0 then 'n/a' when seq % 31 = 0 then {ODD_SQL} else cpm::varchar end, '') as value, unit || case when seq % 5 = 0 then '{BLANK}' else ' ' end as unit, case when seq % 7 = 0 then '' else md5sum end as md5sum from readings),
mapped as (select case when seq % 3 <> 0 then o_sensor when seq % 15 <> 0 then 'd' || o_sensor end as sensor_id, strftime(o_captured, '%Y-%m-%dT%H:%M:%S') as captured_at,
    case when seq % 11 = 0 then strftime(o_captured, '%Y-%m-%dT%H:%M:%S') else strftime(o_uploaded, '%Y-%m-%dT%H:%M:%S+00:00') end as uploaded_at,
    case when seq % 23 = 0 then null when seq % 29 = 0 then 95.5::double else o_latitude end as latitude, o_longitude as longitude, case when o_unit = 'cpm' and seq % 13 <> 0 then case when seq % 31 = 0 then [null, null, null, null, 10.0::double, 7.5, 5.0, 8.0][seq // 31 % {len(ODD_NUMBERS)} + 1] else cpm end end as cpm, case when o_unit in ({UNITS_SQL}) then o_unit end as unit,
    case when seq % 15 = 0 then 'no sensor' when seq % 23 = 0 or seq % 29 = 0 then 'no position' end as reject_reason, case when raw.md5sum <> '' then raw.md5sum else
      md5(concat_ws(',', {", ".join(f"'{c}=' || raw.{c}" for c in sorted(("captured_at", "uploaded_at", "sensor_id", "device_id", "latitude", "longitude", "value", "unit", "md5sum")))})) end as md5sum
  from raw)
"""

SQL = {
    "csv_map_events": sql(MAPPED_SQL, "select * from mapped"),
    "csv_scan": sql(MAPPED_SQL, "select * from mapped"),
    "backfill_spans": sql(MAPPED_SQL, ", spans as (select * from (values ('both', '2024-01-05T06:00:00', '2024-01-20T12:00:00'), ('from', '2024-01-25T00:00:00', '9'), ('until', '0', '2024-01-02T00:00:00'), ('preset', '2011-03-11T00:00:00', '2011-04-30T23:59:59'), ('preset_open', '2011-03-11T00:00:00', '2024-01-03T00:00:00')) v(span, low, high))",
      "select span, count(captured_at) as events, min(captured_at) as first, max(captured_at) as last from spans left join (select * from mapped where reject_reason is null) on captured_at between low and high group by span"),
    "validate_reasons": sql("""select reason, count(*) as events, min(seq) as first_seq, sum(seq)::bigint as sum_seq from (select seq, case when seq % 41 = 0 or seq % 43 = 0 then 'not an object' when seq % 19 = 0 then 'missing field' when seq % 29 = 0 then 'cpm not numeric'
      when seq % 47 <> 0 and (seq % 31 = 0 or seq % 37 = 0) then 'cpm out of range' when seq % 23 = 0 or (seq % 11 = 0 and seq // 11 % 6 < 5) or unit = 'bogus' or seq % 47 = 0 or seq % 53 = 0 or seq % 59 = 0 then 'schema violation' else 'valid' end as reason from readings) group by reason"""),
    "clean_filters": sql("select seq, sensor_id, cpm, unit from readings where cpm between 0 and 1000000"),
    "dedup_first": sql(f"select seq, sensor_id, md5sum, {text_sql('uploaded_at')} as uploaded_at from (select *, row_number() over (partition by sensor_id, md5sum order by uploaded_at, seq) as rn from readings) where rn = 1"),
    "classify_levels": sql(f"select seq, cpm, c as classification, case c when 'SAFE' then 1 when 'WARN' then 2 when 'DANGER' then 3 else 0 end::int as severity from (select seq, cpm, {class_sql('cpm')} as c from readings)"),
    "config_fold": sql(LOG_SQL, f"""select version, {text_sql("effective_at")} as effective_at, warn, danger, case when max_lat is not null then -60.0::double end as area_min_lat, max_lat as area_max_lat, case when max_lat is not null then -170.0::double end as area_min_lon, max_lon as area_max_lon,
      case when span_end is not null then '2024-01-03 00:00:00' end as timespan_start, {text_sql("span_end::timestamp")} as timespan_end from versions""", recursive=True),
    "classify_asof_config": sql(ACCEPTED_SQL, ASOF_SQL, f"select seq, cpm, coalesce(version, 0) as version, {class_sql('cpm', 'coalesce(warn, 100)', 'coalesce(danger, 1000)')} as classification from joined", recursive=True),
    "region_filter": sql(ACCEPTED_SQL, ASOF_SQL, "select seq, sensor_id, latitude, longitude from joined where not has_config or ((max_lat is null or (latitude between -60 and max_lat and longitude between -170 and max_lon)) and (span_end is null or (captured_at >= timestamp '2024-01-03' and captured_at < span_end)))", recursive=True),
    "geohash_cells": sql("select seq, " + ", ".join(f"{geohash_sql('latitude', 'longitude', p)} as geohash{p}" for p in (2, 5, 7)) + " from readings"),
    "cell_windows": sql(ACCEPTED_SQL, CELLS_SQL, f"select {CELL_COLUMNS} from cells"),
    "worst_class": sql(ACCEPTED_SQL, "select sensor_id, case max(case classification when 'SAFE' then 1 when 'WARN' then 2 else 3 end) when 1 then 'SAFE' when 2 then 'WARN' else 'DANGER' end as worst_classification, count(*) as readings from classed group by sensor_id"),
    "rolling_zscore": sql(ACCEPTED_SQL, CELLS_SQL, f"select geohash, {text_sql('window_start')} as window_start, cpm_avg, rolling_cpm_avg, cpm_zscore, anomaly from cells_scored"),
    "sustained_high": sql(ACCEPTED_SQL, HIGH_SQL, f"select sensor_id, 'sustained-high' as reason, {text_sql('window_start')} as window_start, {text_sql('window_end')} as window_end, cpm, breach_count, 'DANGER' as classification, latitude, longitude, triggered_at from high"),
    "alert_cooldown": sql(ACCEPTED_SQL, HIGH_SQL, COOL_SQL, f"select sensor_id, {text_sql('window_start')} as window_start, {text_sql('window_end')} as window_end, cpm, breach_count from cool", recursive=True),
    "rising_trend": sql(ACCEPTED_SQL, CELLS_SQL, TREND_SQL, f"""select geohash as sensor_id, 'rising-trend' as reason, {text_sql("window_start")} as window_start, {text_sql("window_end")} as window_end, cpm_max as cpm, 3::int as breach_count, centroid_latitude as latitude, centroid_longitude as longitude,
      strftime(window_end, '%Y-%m-%dT%H:%M:%S+00:00') as triggered_at, geohash, 3::int as trend_window_count, concat_ws(',', floor(a * 10000 + 0.5)::bigint, floor(b * 10000 + 0.5)::bigint, floor(cpm_avg * 10000 + 0.5)::bigint) as trend_cpm_series, {round_sql("cpm_avg - a")} as trend_delta from trend""", recursive=True),
    "alert_hot_region": sql(ACCEPTED_SQL, CELLS_SQL, HIGH_SQL, COOL_SQL, f", placed_alerts as (select *, {geohash_sql('latitude', 'longitude', PRECISION)} as geohash from cool)", f"select a.sensor_id, {text_sql('a.window_end')} as window_end, a.cpm, a.geohash, {', '.join(('coalesce(c.count, 0)' if x == 'count' else f'c.{x}') + f' as hot_region_{x}' for x in REGION)} from placed_alerts a asof left join cells c on a.geohash = c.geohash and a.window_end >= c.window_end", recursive=True),
    "alerts_union": sql(ACCEPTED_SQL, CELLS_SQL, HIGH_SQL, COOL_SQL, TREND_SQL, UNION_SQL, f"select sensor_id, reason, {text_sql('window_start')} as window_start, {text_sql('window_end')} as window_end, cpm, breach_count::int as breach_count, classification, geohash from both_kinds", recursive=True),
    "mobility_tag": sql(f"""select seq, sensor_id, {text_sql("uploaded_at")} as uploaded_at, case when max(far) over (partition by sensor_id order by seq, uploaded_at rows unbounded preceding) then 'mobile' else 'fixed' end as sensor_type from (
      select *, 2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(hi_lat - lo_lat) / 2), 2) + cos(radians(lo_lat)) * cos(radians(hi_lat)) * power(sin(radians(hi_lon - lo_lon) / 2), 2)))) > 200 as far from (
      select *, min(latitude) over w as lo_lat, max(latitude) over w as hi_lat, min(longitude) over w as lo_lon, max(longitude) over w as hi_lon from readings window w as (partition by sensor_id order by seq, uploaded_at rows unbounded preceding)))"""),
    "fleet_counts": sql("""select count(*) as sensors_seen, coalesce(sum(mobile::int), 0)::bigint as mobile_count from (select sensor_id, 2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(max(latitude) - min(latitude)) / 2), 2)
      + cos(radians(min(latitude))) * cos(radians(max(latitude))) * power(sin(radians(max(longitude) - min(longitude)) / 2), 2)))) > 200 as mobile from readings group by sensor_id)"""),
    "archive_latest": sql(ACCEPTED_SQL, CELLS_SQL, ARCHIVE_SQL, f"select geohash, {text_sql('window_start')} as window_start, count, cpm_avg, class_counts_DANGER as danger_count, batch_id::int as batch_id from archive"),
    "insight_summary": sql(ACCEPTED_SQL, CELLS_SQL, ARCHIVE_SQL, f"select count(*) as windows, count(distinct geohash) as cells, count(*) filter (anomaly) as anomalies, {text_sql('min(window_start)')} as first_window, {text_sql('max(window_start)')} as last_window, max(cpm_max) as peak_cpm from archive"),
    "insight_timeseries": sql(ACCEPTED_SQL, CELLS_SQL, ARCHIVE_SQL, f"select {text_sql('window_start')} as window_start, sum(count)::bigint as count, {round_sql(WEIGHTED)} as cpm_avg, max(cpm_max) as cpm_max, coalesce(sum(class_counts_DANGER), 0)::bigint as danger_count, count(*) filter (anomaly) as anomaly_cells, count(*) filter (anomaly) > 0 as flagged from archive where {IN_VIEW} group by archive.window_start order by archive.window_start desc limit 5000"),
    "insight_hotspots": sql(ACCEPTED_SQL, CELLS_SQL, ARCHIVE_SQL, f", spots as (select geohash, {round_sql('sum(centroid_latitude::decimal(18,6))::double / count(*)')} as latitude, {round_sql('sum(centroid_longitude::decimal(18,6))::double / count(*)')} as longitude, {round_sql(WEIGHTED)} as cpm_avg, max(cpm_max) as peak_cpm, sum(count)::bigint as count, count(*) as windows, count(*) filter (anomaly) as anomaly_windows from archive group by geohash order by peak_cpm desc nulls last, geohash limit 10)", f"select *, {round_sql('greatest(0.03, peak_cpm / greatest(1.0, max(peak_cpm) over ()))')} as share from spots"),
    "archive_timeseries": sql(ACCEPTED_SQL, CELLS_SQL, ARCHIVE_SQL, f"select {text_sql('window_start')} as window_start, sum(count)::bigint as count, {round_sql(WEIGHTED)} as cpm_avg, max(cpm_max) as cpm_max, coalesce(sum(class_counts_DANGER), 0)::bigint as danger_count, count(*) filter (anomaly) as anomaly_cells, count(*) filter (anomaly) > 0 as flagged from archive where {IN_VIEW} group by archive.window_start order by archive.window_start desc limit 5000"),
    "archive_anomalies": sql(ACCEPTED_SQL, CELLS_SQL, ARCHIVE_SQL, f"select geohash, {text_sql('window_start')} as window_start, count, cpm_avg, cpm_zscore from archive where anomaly and window_start between timestamp '2024-01-05' and timestamp '2024-01-20 12:00:00'"),
    "sql_hotspots": sql(ACCEPTED_SQL, CELLS_SQL, ARCHIVE_SQL, f"select geohash, {round_sql('sum(centroid_latitude::decimal(18,6))::double / count(*)')} as latitude, {round_sql('sum(centroid_longitude::decimal(18,6))::double / count(*)')} as longitude, {round_sql(WEIGHTED)} as cpm_avg, max(cpm_max) as peak_cpm, sum(count)::bigint as count, count(*) as windows, count(*) filter (anomaly) as anomaly_windows from archive where {IN_VIEW} group by geohash order by peak_cpm desc nulls last, geohash limit 20"),
    "sql_alert_levels": sql(ACCEPTED_SQL, CELLS_SQL, HIGH_SQL, COOL_600_SQL, TREND_SQL, f", levels as (select 'sustained-high' as reason, cpm from cool union all select 'rising-trend', cpm_max from trend)", f"select reason, level, case level when 'SAFE' then 1 when 'WARN' then 2 when 'DANGER' then 3 end::int as rank, count(*) as alerts, max(cpm) as peak from (select reason, cpm, {class_sql('cpm')} as level from levels) group by reason, level", recursive=True),
    "density_histogram": sql(ACCEPTED_SQL, ", newest as (select epoch_ms(captured_at) as t from accepted order by seq desc, captured_at desc limit 5000), ends as (select min(t) as lo, max(t) as hi from newest), bins as (select least((t - lo) * 60 // greatest(hi - lo, 1), 59)::int as bin, count(*) as n from newest, ends group by 1)", "select r.bin, coalesce(n, 0)::bigint as count from (select unnest(range(60))::int as bin) r left join bins using (bin)"),
    "latest_per_sensor": sql(f"select sensor_id, seq, {text_sql('uploaded_at')} as uploaded_at, cpm from (select *, row_number() over (partition by sensor_id order by seq desc, uploaded_at desc) as rn from readings) where rn = 1"),
    "recent_page": sql(ACCEPTED_SQL, ", held as (select * from (select * from accepted order by seq desc limit 500) where seq < (select max(seq) - 20 from accepted)), shown as (select * from held order by seq desc limit 25)", "select seq, sensor_id, cpm, (select count(*) from held) > 25 as has_more, (select min(seq) from shown) as next_cursor from shown"),
    "view_filter_failopen": sql("select seq, sensor_id, latitude, cpm from (select seq, sensor_id, case when seq % 27 <> 0 then latitude end as latitude, longitude, case when seq % 35 <> 0 then captured_at end as t, cpm from readings) where coalesce(latitude between -40 and 50 and longitude between -120 and 120, true) and coalesce(t between timestamp '2024-01-05' and timestamp '2024-01-20 12:00:00', true)"),
    "view_recolor": sql(ACCEPTED_SQL, f"select seq, classification, {class_sql('cpm', '250', '1500')} as shown_class from classed"),
    "alert_log_newest": sql(ACCEPTED_SQL, CELLS_SQL, HIGH_SQL, COOL_SQL, TREND_SQL, UNION_SQL, f"select sensor_id, reason, {text_sql('window_start')} as window_start, {text_sql('window_end')} as window_end, cpm from (select * from both_kinds order by window_end desc, sensor_id, reason, window_start desc limit 50)", recursive=True),
    "newest_by_key": sql("select sensor_id, strftime(captured_at, '%Y-%m-%d') as day, max(seq) as seq from readings group by 1, 2 order by seq desc limit 100"),
    "delivery_order": sql(ACCEPTED_SQL, """select 0::int as lane, seq, sensor_id, cpm from (select * from classed where classification = 'DANGER' order by seq desc limit 100)
      union all select 1::int, seq, sensor_id, cpm from (select * from (select *, row_number() over (partition by sensor_id order by seq desc) as rn from classed) where rn = 1 order by seq desc limit 5000)"""),
    "json_round_trip": sql(f"select sensor_id, count(*) as readings, count(*) filter (unit = 'cpm') as with_unit, count(cpm) as with_value, max(cpm) as peak, count(distinct md5sum) as distinct_md5, {text_sql('max(captured_at)')} as last_captured from readings group by sensor_id"),
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
