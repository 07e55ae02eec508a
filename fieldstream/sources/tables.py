"""Scans, streams, JSON and the archive."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Header names, folded, and the internal columns they mean.
ALIASES = {
    "captured_time": "captured_at", "captured_at": "captured_at", "uploaded_time": "uploaded_at", "uploaded_at": "uploaded_at", "device_id": "device_id", "sensor_id": "sensor_id",
    "latitude": "latitude", "longitude": "longitude", "value": "value", "unit": "unit", "height": "height", "location_name": "location_name", "surface": "surface", "md5sum": "md5sum",
    "measurement_import_id": "measurement_import_id", "loader_id": "measurement_import_id",
}
TOPICS = {"clean": "clean", "aggregated": "aggregated", "alerts": "alert"}
ARCHIVE_KEY = ("geohash", "window_start")


def fold_header(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def with_known_columns(rows: DataFrame) -> DataFrame:
    """Columns under their internal names; unknown ones are dropped, of two that mean the same the first stays."""
    found: dict[str, str] = {}
    for c in rows.columns:
        if (name := ALIASES.get(fold_header(c))) and name not in found:
            found[name] = c
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for n, c in found.items()))


def without_first(rows: DataFrame, skip: int) -> DataFrame:
    """Rows of a file scan but for the first ``skip``, files in order of their paths.

    Each split counts its rows; only one row for each split meets in one task, and no row of the scan moves.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    upto = F.sum("n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    splits = placed.groupBy("__file", "__block").agg(F.min("__id").alias("first"), F.count("*").alias("n")).withColumn("upto", upto)
    # ids rise by one inside a split; no split left: null, so no row passes
    start = F.struct("__file", "__block", (F.col("first") + skip - F.col("upto") + F.col("n")).alias("__id"))
    cut = splits.where(F.col("upto") > skip).agg(F.min(start).alias("__start"))
    return placed.crossJoin(F.broadcast(cut)).where(F.struct("__file", "__block", "__id") >= F.col("__start")).select(*(f"`{c}`" for c in rows.columns))


def read_csv(spark: SparkSession, path: str, skip_rows: int = 0) -> DataFrame:
    """All columns as text, missing cells empty, the first ``skip_rows`` rows left out."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    return with_known_columns(without_first(rows, skip_rows) if skip_rows > 0 else rows)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="fieldstream-")
    at = spark._jvm.org.apache.hadoop.fs.Path(made)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def in_upload_order(rows: DataFrame, whole: bool = False) -> DataFrame:
    """By uploaded_at, or captured_at without it, blanks last; within partitions, or over all with ``whole``."""
    column = "uploaded_at" if "uploaded_at" in rows.columns else "captured_at"
    key = F.nullif(F.trim(F.col(column)), F.lit("")).asc_nulls_last()
    return rows.orderBy(key) if whole else rows.sortWithinPartitions(key)


def security_options(env: Mapping[str, str]) -> dict[str, str]:
    """Connection options for a broker: none for PLAINTEXT, else protocol, mechanism and login."""
    protocol = env.get("KAFKA_SECURITY_PROTOCOL", "PLAINTEXT").upper()
    if protocol == "PLAINTEXT":
        return {}
    options = {"kafka.security.protocol": protocol}
    if protocol.startswith("SASL"):
        mechanism = env.get("KAFKA_SASL_MECHANISM", "PLAIN")
        module = "org.apache.kafka.common.security." + ("scram.ScramLoginModule" if mechanism.startswith("SCRAM") else "plain.PlainLoginModule")
        user, secret = (env.get(k, "").replace("\\", "\\\\").replace('"', '\\"') for k in ("KAFKA_SASL_USERNAME", "KAFKA_SASL_PASSWORD"))
        options |= {"kafka.sasl.mechanism": mechanism, "kafka.sasl.jaas.config": f'{module} required username="{user}" password="{secret}";'}
    return options


def topic_options(servers: str, topics: list[str], env: Mapping[str, str] | None = None, start: str = "earliest") -> dict[str, str]:
    """Options of ``readStream.format("kafka")``."""
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": start, "failOnDataLoss": "false"} | security_options(env or {})


def publish_options(servers: str, topic: str, env: Mapping[str, str] | None = None, batch_bytes: int = 65_536, linger_ms: int = 20, codec: str = "lz4") -> dict[str, str]:
    """Options of a keyed, acknowledged write to a topic."""
    return {
        "kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3", "kafka.batch.size": str(batch_bytes), "kafka.linger.ms": str(linger_ms), "kafka.compression.type": codec,
    } | security_options(env or {})


def topic_stream(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Messages of topics as a stream: key, value (text), topic, timestamp.  Needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**options).load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp")


def envelope(messages: DataFrame) -> DataFrame:
    """(type, data) of the known topics; malformed data is left out."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in TOPICS.items() for x in kv)), F.regexp_extract("topic", r"([a-z]+)$", 1))
    return messages.select(kind.alias("type"), F.col("value").alias("data")).where(F.col("type").isNotNull() & F.try_parse_json("data").isNotNull() & F.trim("data").startswith("{"))


def to_json(*columns: str | Column) -> Column:
    """A JSON object with explicit nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def event_json(df: DataFrame) -> Column:
    """A reading as JSON: nulls explicit, but no ``unit`` where there is none."""
    others = [c for c in df.columns if c != "unit"]
    return F.when(F.col("unit").isNull(), to_json(*others)).otherwise(to_json(*df.columns)) if "unit" in df.columns else to_json(*others)


def keyed(events: DataFrame) -> DataFrame:
    """(key, value) to publish: the sensor and the event's JSON."""
    return events.select(F.col("sensor_id").alias("key"), event_json(events).alias("value"))


def observed_delivery(checked: DataFrame, name: str) -> DataFrame:
    """Valid events out of rows with ``discard_reason`` (see ``Q.discard_reason``), with metrics of what is sent and what is discarded."""
    bad = F.col("discard_reason").isNotNull()
    counted = checked.observe(name, F.count_if(~bad).alias("rows"), F.count_if(bad).alias("discarded"))
    return counted.where(~bad).drop("discard_reason")


def console_line() -> Column:
    """One line about a clean event, with four digits of its position."""
    return F.format_string("%s %s cpm=%s %s (%.4f, %.4f)", F.col("captured_at").cast("string"), "sensor_id", F.col("cpm").cast("string"), "classification", "latitude", "longitude")


def archive_rows(cells: DataFrame) -> DataFrame:
    """Cells with flat class counts; rows without a key or a count are left out."""
    flat = cells.where("geohash is not null and window_start is not null and count is not null")
    counts = [F.coalesce(f"class_counts.{k}", F.lit(0)).alias(f"{k.lower()}_count") for k in ("SAFE", "WARN", "DANGER")]
    return flat.select(*(c for c in cells.columns if c != "class_counts"), *counts)


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One batch of archive rows in a folder of its own, so a replay overwrites what it wrote before."""
    dated = rows.withColumn("ingested_at", F.current_timestamp()).withColumn("window_date", F.to_date("window_start"))
    dated.sortWithinPartitions("geohash").write.mode("overwrite").partitionBy("window_date").parquet(f"{path}/batch_id={batch_id}")


def latest_rows(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Of rows with one key, that of the last batch."""
    order = Window.partitionBy(*ARCHIVE_KEY).orderBy(F.col(batch).desc())
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive as its last batches have it."""
    return latest_rows(spark.read.parquet(path))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the latest rows as one batch below another path, partitioned by day."""
    if path.rstrip("/") == to.rstrip("/"):
        raise ValueError("an archive can't be compacted over itself")
    read_archive(spark, path).drop("batch_id").repartition("window_date").sortWithinPartitions("geohash").write.partitionBy("window_date").parquet(f"{to}/batch_id=0")
