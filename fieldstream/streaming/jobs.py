"""The streaming jobs, one stage per table.

raw -> clean (checks, repeats, class by the current configuration), clean ->
cells (tumbling windows, rolling statistics), cells -> rising trends, clean ->
sustained alerts after a cooldown, alerts and cells -> alerts with their region.
Sources and sinks are streams of the same shape from Kafka or from files.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

from fieldstream.functions import expr as X
from fieldstream.operators import alerts as A
from fieldstream.operators import cells as C
from fieldstream.operators import clean as Q
from fieldstream.operators import config_log as G
from fieldstream.operators import ingest as I
from fieldstream.operators import views as V
from fieldstream.schemas import ALERT, CELL, EVENT, HOT_REGION, LOG, TREND
from fieldstream.sources.archive import Archive
from fieldstream.sources.tables import archive_rows, console_line, to_json
from fieldstream.streaming.processors import Cooldown, CooldownByTime, FirstOfRepeats, Mobility, NewestCell, Pending, RegionByTime, RisingTrend, Rolling, TrendByTime

LATE, EVERY, PAUSE, FLUSH = "30 seconds", "60 seconds", 3600, "1 second"
#: What keyed state needs.  State with a wall-clock life asks for a batch without data again and again, so jobs that end
#: when their input does (availableNow) set spark.sql.streaming.noDataMicroBatches.enabled to false.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.multipleWatermarkPolicy": "min"}


@dataclass(frozen=True)
class Running:
    """How jobs run: seconds between batches (each is a checkpoint), the folder that keeps checkpoints, and whether state is written as changes or whole.

    A batch that takes longer than the interval is followed at once; Spark has no pause and no timeout of a checkpoint apart from those of its tasks.
    """

    folder: str
    interval_s: float = 60.0
    changelog: bool = True
    kept_batches: int = 100

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Running:
        """From CHECKPOINT_DIR, CHECKPOINT_INTERVAL_MS, CHECKPOINT_CHANGELOG and CHECKPOINT_KEPT; blank ones count as unset."""
        said = {k: v.strip() for k, v in env.items() if v.strip()}
        if "CHECKPOINT_DIR" not in said:
            raise ValueError("CHECKPOINT_DIR must name a folder that all executors share")
        interval, kept_batches = int(said.get("CHECKPOINT_INTERVAL_MS", 60_000)), int(said.get("CHECKPOINT_KEPT", 100))
        if interval <= 0 or kept_batches <= 0:
            raise ValueError("interval and kept batches must be positive")
        return cls(said["CHECKPOINT_DIR"].rstrip("/"), interval / 1000, said.get("CHECKPOINT_CHANGELOG", "true").lower() in ("1", "true", "yes"), kept_batches)

    def apply(self, spark: SparkSession) -> None:
        changes = {"spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": str(self.changelog).lower(), "spark.sql.streaming.minBatchesToRetain": str(self.kept_batches)}
        for k, v in (SETTINGS | changes).items():
            spark.conf.set(k, v)

    def place(self, job: str) -> str:
        return f"{self.folder}/{job}"

    def start(self, writer, job: str, once: bool = False):
        """Start a job under its name, on its own checkpoint; ``once`` ends it with its input."""
        every = {"availableNow": True} if once else {"processingTime": f"{self.interval_s} seconds"}
        return writer.queryName(job).option("checkpointLocation", self.place(job)).trigger(**every).start()


def clean_events(messages: DataFrame, late: str = LATE) -> DataFrame:
    """Parsed, plausible, first of its repeats within the watermark; on a stream or a table of JSON ``value``."""
    events = Q.plausible(Q.with_value(Q.parse(messages))).withColumn("dedup_key", X.dedup_key(F.col("md5sum"), F.col("captured_at")))
    return events.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["sensor_id", "dedup_key"]).drop("dedup_key")


def clean_events_by_clock(messages: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """As ``clean_events``, but a repeat is known for a wall-clock time instead of an event-time one."""
    events = Q.plausible(Q.with_value(Q.parse(messages)))
    keyed = events.withColumn("dedup_key", X.dedup_key(F.col("md5sum"), F.col("captured_at")))
    return keyed.groupBy("sensor_id").transformWithState(FirstOfRepeats(events.columns, "uploaded_at", ttl_ms), events.schema, "Append", "ProcessingTime")


def classify_batch(events: DataFrame, versions: DataFrame) -> DataFrame:
    """A batch of events with class and in_region by the current configuration, one broadcast row."""
    now = G.current(versions).select("warn", "danger", F.struct("area", "timespan").alias("__rule"))
    joined = events.crossJoin(F.broadcast(now))
    inside = G.in_region(F.col("__rule"), F.col("latitude"), F.col("longitude"), F.col("captured_at"))
    return joined.withColumn("classification", X.classify(F.col("cpm"), F.col("warn"), F.col("danger"))).withColumn("in_region", inside).drop("warn", "danger", "__rule")


def write_clean(events: DataFrame, read_versions: Callable[[], DataFrame], path: str, checkpoint: str):
    """Start the job raw -> clean.  Each batch has a folder of its own, so a replay overwrites it."""

    def put(batch: DataFrame, batch_id: int) -> None:
        classify_batch(batch, read_versions()).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def write_checked(messages: DataFrame, path: str, checkpoint: str):
    """Start the job raw -> valid messages, quarantine and counts by reason, three folders below ``path``.

    A batch is judged once.  What it gives has its id in every folder, so a replay overwrites each of them; quarantined
    messages keep their text.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        judged = Q.decode(batch).withColumn("discard_reason", Q.discard_reason(F.col("event"), F.col("value"))).persist()
        try:
            judged.where("discard_reason is null").select("event.*").write.mode("overwrite").parquet(f"{path}/valid/batch_id={batch_id}")
            judged.where("discard_reason is not null").drop("event").write.mode("overwrite").parquet(f"{path}/quarantine/batch_id={batch_id}")
            reasons = judged.groupBy(F.coalesce("discard_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("messages"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("bytes"))
            reasons.coalesce(1).write.mode("overwrite").parquet(f"{path}/reasons/batch_id={batch_id}")
        finally:
            judged.unpersist()

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def write_config_log(messages: DataFrame, path: str, checkpoint: str):
    """Start the job configuration topic -> log.  Malformed and invalid messages are left out, so the last good one stays in force."""

    def put(batch: DataFrame, batch_id: int) -> None:
        place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # a batch of a configuration topic is a few messages
        rows = batch.select(G.parse_message(F.col("value")).alias("c"), place.alias("n")).where("c is not null").where(G.fault(F.col("c")).isNull())
        version = F.lit(batch_id).cast("long") * 1_000_000 + F.col("n")
        rows.select(version.alias("version"), F.current_timestamp().alias("effective_at"), "c.*").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def config_versions(spark: SparkSession, path: str) -> DataFrame:
    """The versions that ``write_config_log`` has accepted so far; each is a whole configuration.  None where nothing was written yet."""
    schema = StructType([*(StructField(n, t) for n, t in LOG.items())])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch_id=*")


def write_delivery(messages: DataFrame, path: str, checkpoint: str, every: str = FLUSH):
    """Start the job that delivers to viewers: of each batch (type, key, order and data), alerts first, then the newest message of each type and key."""

    def put(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("state_key", F.concat_ws("/", "type", "key"))
        alerts, state = named.where("type = 'alert'"), named.where("type <> 'alert'")
        V.delivery(alerts, state, "state_key", "order").drop("state_key").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def deliver(messages: DataFrame, views: Mapping[str, V.View], flush_s: float = 1.0, most_alerts: int = V.MOST_ALERTS, most_keys: int = V.MOST_KEYS) -> DataFrame:
    """What each client gets of a stream of messages (type, key, order, data, and latitude, longitude and time to filter by), at most one flush in ``flush_s`` seconds.

    ``views`` has one entry for each client.  Between flushes messages wait in the client's state: those with a key are replaced by newer ones of the type and key, alerts and
    messages without a key queue.  Beyond ``most_alerts`` the oldest of the queue goes, beyond ``most_keys`` the key that changed longest ago.  A flush gives the queue, then
    the newest of each key in the order of their last change; each row has the flush's number and the client's counts so far of messages replaced, dropped and filtered.
    """
    known = F.col("type").isin(*V.FIELDS)
    seen = lambda view: ~known | view.holds((F.col("latitude"), F.col("longitude")), [F.col("time")])
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("client"), seen(view).alias("seen")) for name, view in views.items()))).alias("c")
    rows = messages.select("type", "key", "order", "data", each).select("c.*", "type", "key", "order", "data")
    schema = "client string, flush long, lane int, type string, key string, order long, data string, replaced long, dropped long, filtered long"
    return rows.groupBy("client").transformWithState(Pending(flush_s, most_alerts, most_keys), schema, "Append", "ProcessingTime")


def mobility(events: DataFrame, least_m: float = I.MOBILE_M, order: str = "uploaded_at") -> DataFrame:
    """A stream of events with sensor_type, by all positions of a sensor so far."""
    schema = StructType([*(f for f in events.schema.fields if f.name != "sensor_type"), StructField("sensor_type", StringType())])
    return events.groupBy("sensor_id").transformWithState(Mobility(events.columns, order, least_m, X.EARTH_M), schema, "Append", "ProcessingTime")


class Counters(StreamingQueryListener):
    """Adds up what the queries observe (see ``observed`` and ``observed_messages``), the rows that came too late, and failed queries."""

    def __init__(self):
        self.totals: dict[str, int] = {"late": 0, "errors": 0}
        self.last_event, self.began = None, time.time()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            for name, value in row.asDict().items():
                if name == "last_event":
                    self.last_event = max(filter(None, (self.last_event, value)), default=None)
                else:
                    self.totals[name] = self.totals.get(name, 0) + (value or 0)
        self.totals["late"] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.totals["errors"] += event.exception is not None


    def save(self, spark: SparkSession, path: str, run: str) -> None:
        """Write what this run has counted so far; a later call for the same run takes its place."""
        row = {"run": run, "seconds": time.time() - self.began, "last_event": None if self.last_event is None else str(self.last_event)}
        for sent, seen in (("sent", "rows"), ("discarded", "discarded"), ("malformed", "malformed"), ("errors", "errors"), ("late", "late"), ("bytes", "bytes")):
            row[sent] = int(self.totals.get(seen, 0))
        kinds = {"run": "string", "seconds": "double", "last_event": "string"}
        schema = ", ".join(f"{k} {kinds.get(k, 'long')}" for k in row)
        spark.createDataFrame([tuple(row.values())], schema).drop("run").coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}")


def run_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row over all runs that ``Counters.save`` wrote: sums, the newest event, and events a second."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/run=*")
    sums = [F.sum(c).alias(c) for c in ("sent", "discarded", "malformed", "errors", "late", "bytes", "seconds")]
    return rows.agg(F.count("*").alias("runs"), *sums, F.max("last_event").alias("last_event")).withColumn("per_second", F.when(F.col("seconds") > 0, F.col("sent") / F.col("seconds")).otherwise(0.0))


def timed(clean: DataFrame, late: str | None) -> DataFrame:
    """With a watermark; a stream that has one already (``late`` None) keeps it."""
    return clean.withWatermark("captured_at", late) if late else clean


def cells(clean: DataFrame, precision: int = 5, window: str = "60 seconds", late: str | None = LATE) -> DataFrame:
    """Closed cell windows of a stream of clean events."""
    return C.cell_windows(timed(clean, late), precision, window)


def scored(cell_stream: DataFrame, window_s: int = 60) -> DataFrame:
    """Cells with rolling statistics, kept per cell."""
    schema = StructType([*cell_stream.schema.fields, *(f for f in CELL.fields if f.name in ("rolling_cpm_avg", "cpm_zscore", "anomaly"))])
    return cell_stream.groupBy("geohash").transformWithState(Rolling(cell_stream.columns, ttl_ms=max(10 * window_s, PAUSE) * 1000), schema, "Append", "ProcessingTime")


def trends(cell_stream: DataFrame, windows: int = A.TREND_WINDOWS, least: float = A.TREND_DELTA, window_s: int = 60) -> DataFrame:
    """Rising trends of a stream of cells."""
    schema = "geohash string, window_start timestamp, window_end timestamp, cpm double, cpm_series array<double>, delta double"
    return cell_stream.groupBy("geohash").transformWithState(RisingTrend(windows, least, max(10 * window_s, PAUSE) * 1000), schema, "Append", "ProcessingTime")


def sustained(clean: DataFrame, window: str = "300 seconds", slide: str = "60 seconds", cooldown_s: int = A.COOLDOWN_S, late: str | None = LATE, tie: str = "tie") -> DataFrame:
    """Sustained alerts of a stream of clean events, after the cooldown."""
    rows = timed(clean, late)
    if tie not in clean.columns:
        rows = rows.withColumn(tie, F.xxhash64("md5sum", "uploaded_at"))
    high = A.sustained_high(rows, window, slide, tie=tie)
    return high.groupBy("sensor_id").transformWithState(Cooldown(high.columns, cooldown_s), high.schema, "Append", "ProcessingTime")


def regional(alerts: DataFrame, cell_stream: DataFrame, precision: int = 5, window_s: int = 60) -> DataFrame:
    """geohash, alert (JSON) and hot_region (JSON of the newest cell, or null)."""
    names = ("cpm_avg", "cpm_max", "count", "worst_classification", "centroid_latitude", "centroid_longitude")
    a = alerts.select(F.coalesce(X.geohash(F.col("latitude"), F.col("longitude"), precision), F.lit("")).alias("geohash"), "window_end", F.lit(None).cast("string").alias("cell"), to_json(*alerts.columns).alias("alert"))
    c = cell_stream.select("geohash", "window_end", to_json(*names).alias("cell"), F.lit(None).cast("string").alias("alert"))
    return c.union(a).groupBy("geohash").transformWithState(NewestCell(max(10 * window_s, PAUSE) * 1000), "geohash string, alert string, hot_region string", "Append", "ProcessingTime")


def alert_stream(clean: DataFrame, precision: int = 5, cell: str = "60 seconds", window: str = "300 seconds", slide: str = "60 seconds", cooldown_s: int = A.COOLDOWN_S, tie: str = "tie", keep_s: int = PAUSE) -> DataFrame:
    """All alerts of a stream of classified events in the form of the contract: sustained ones after the cooldown with their hot_region, and rising trends.

    One running query: windows, cooldown, the join to cells and the trends are chained stateful operators by event
    time, and each hands a watermark on, so an alert meets all cells that ended before it.  The events have a watermark already.
    State of a key goes ``keep_s`` after its last row by event time; the cells that an alert can need ended within its own window.
    """
    rows = clean if tie in clean.columns else clean.withColumn(tie, F.xxhash64("md5sum", "uploaded_at"))
    high = A.sustained_high(rows, window, slide, tie=tie)
    cool = high.groupBy("sensor_id").transformWithState(CooldownByTime(high.columns, cooldown_s), high.schema, "Append", "EventTime", eventTimeColumnName="window_end")
    cells_now = C.cell_windows(clean, precision, cell)
    of_alert = [f for f in ALERT.fields if f.name not in ("hot_region", "trend")]
    placed = cool.withColumn("geohash", X.geohash(F.col("latitude"), F.col("longitude"), precision))
    a = placed.select(F.coalesce("geohash", F.lit("")).alias("key"), F.lit(None).cast(HOT_REGION).alias("cell"), *(f.name for f in of_alert))
    c = cells_now.select(F.col("geohash").alias("key"), F.struct(*(f.name for f in HOT_REGION.fields)).cast(HOT_REGION).alias("cell"), *(F.col("window_end") if f.name == "window_end" else F.lit(None).cast(f.dataType).alias(f.name) for f in of_alert))
    joined = StructType([*of_alert, StructField("hot_region", HOT_REGION)])
    regional = a.union(c).groupBy("key").transformWithState(RegionByTime([f.name for f in of_alert], keep_s), joined, "Append", "EventTime", eventTimeColumnName="window_end")
    steps = cells_now.withColumn("triggered_at", X.iso(F.col("window_end")))
    rising = steps.groupBy("geohash").transformWithState(TrendByTime(keep_s=keep_s), ALERT, "Append", "EventTime", eventTimeColumnName="window_end")
    names = [f.name for f in ALERT.fields]
    return regional.withColumn("trend", F.lit(None).cast(TREND)).select(names).union(rising.select(names))


def write_archive(cell_stream: DataFrame, path: str, checkpoint: str):
    """Start the job cells -> archive: every batch is written to folders named by its id."""
    return cell_stream.writeStream.foreachBatch(lambda batch, k: Archive(batch.sparkSession, path).append(archive_rows(batch), k)).option("checkpointLocation", checkpoint)


def write_topic(rows: DataFrame, options: dict[str, str], checkpoint: str, every: str = EVERY):
    """Key and JSON value to a topic, at least once."""
    return rows.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def write_console(clean: DataFrame, checkpoint: str):
    return clean.select(console_line().alias("line")).writeStream.format("console").option("truncate", False).option("checkpointLocation", checkpoint)


def read_json_folder(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """The file twin of a topic: one JSON message per line of text files, ``per_batch`` files a batch."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(path)


def read_table_folder(spark: SparkSession, path: str, kind: str, per_batch: int = 1) -> DataFrame:
    """The file twin of the topics between the jobs."""
    return spark.readStream.schema({"clean": EVENT, "cells": CELL}[kind]).option("maxFilesPerTrigger", per_batch).parquet(path)
