"""The readings that the registered queries work on, derived from the table ``events``.

Events have no place and no unit, so these come from integer arithmetic on ids;
every tenth reading is sent twice.  Integers are divided last, so other engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, sensor_id, captured_at, uploaded_at, latitude, longitude, cpm, unit, md5sum."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    u, i = F.col("user_id"), F.col("event_id")
    jitter = F.when(u % 4 == 0, i % 40).otherwise(0)
    rows = e.select(
        i.alias("seq"), u.cast("string").alias("sensor_id"), F.col("ts").alias("captured_at"), F.timestamp_seconds(F.unix_seconds("ts") + i % 90).alias("uploaded_at"),
        (((u * 7919) % 1200 * 100 - 60_000 + jitter) / 1000.0).alias("latitude"), (((u * 104_729) % 3400 * 100 - 170_000 + jitter) / 1000.0).alias("longitude"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100 + 0.5) / 10.0).alias("cpm"), F.when(i % 17 == 0, "bogus").otherwise("cpm").alias("unit"), F.md5(F.concat_ws("-", u, i)).alias("md5sum"),
    )
    later = F.explode(F.when(F.col("seq") % 10 == 0, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0))))  # one scan
    sent = rows.select("*", later.alias("__later"))
    return sent.withColumn("uploaded_at", F.timestamp_seconds(F.unix_seconds("uploaded_at") + F.col("__later"))).drop("__later")


READINGS_SQL = """
base as (select event_id as seq, cast(user_id as varchar) as sensor_id, ts as captured_at, date_trunc('second', ts) + to_seconds(event_id % 90) as uploaded_at,
    ((user_id * 7919) % 1200 * 100 - 60000 + case when user_id % 4 = 0 then event_id % 40 else 0 end) / 1000.0::double as latitude,
    ((user_id * 104729) % 3400 * 100 - 170000 + case when user_id % 4 = 0 then event_id % 40 else 0 end) / 1000.0::double as longitude,
    case when event_type <> 'error' then floor(value * 100 + 0.5) / 10.0::double end as cpm, case when event_id % 17 = 0 then 'bogus' else 'cpm' end as unit, md5(user_id || '-' || event_id) as md5sum
  from events),
readings as (select * from base union all select seq, sensor_id, captured_at, uploaded_at + interval 5 second, latitude, longitude, cpm, unit, md5sum from base where seq % 10 = 0)
"""
