"""Intermediate tables in the shared folder, and the places of rows in an order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.sources.tables import scratch_dir


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back; removed when the driver ends."""
    spark = rows.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(rows.schema).parquet(path)


def ranked(rows: DataFrame, order: list[str | Column], name: str = "ranked") -> DataFrame:
    """Adds ``__rank``, the place of each row in ``order`` from 0.

    Rows are range-partitioned, and each partition counts its own; only one row for each partition meets in one task.
    """
    placed = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33).alias("__part")
    counts = placed.groupBy(part).agg(F.count("*").alias("__n"), F.min("__at").alias("__from"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__part").alias("__in"), (before - F.col("__from")).alias("__shift"))
    # one row for each partition of the table just written
    return placed.join(F.broadcast(starts), part == F.col("__in")).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("__rank"))
