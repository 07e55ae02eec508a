"""What several operators share: inputs, the shared folder, word splitting and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (local tests) a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="fieldstream-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy survives lost executors; Hadoop removes it when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    held = spark.read.schema(df.schema).parquet(path)
    held.kept_at = path
    return held


def forget(held: DataFrame) -> None:
    """Delete the files of a table that ``keep`` made, once nothing that is still to run reads it."""
    spark = held.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(held.kept_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) as UTF-8 bytes, and the columns in ``more``; nothing else is read."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *more)


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` under one name."""
    return df.mapInArrow(rows, schema)


def in_parts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes each: long texts must not add up in a worker."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
            size += n or 0
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def squeeze(text: bytes) -> bytes:
    """Each run of ASCII white space (space, \\t to \\r) becomes one space."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + body + (b" " if text[-1:].isspace() else b"")


#: Bytes of text that the training sample of either class holds at most.
TRAIN_BYTES = 32 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, per_class: int, per_class_bytes: int = TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_class`` rows and ``per_class_bytes`` bytes of either class, for training on the driver.

    Rows are taken by the order of a hash of doc_id, so a rerun takes the same
    ones; held-out rows, null ids and null labels are never taken.  An id that is labelled both 0 and 1 is left out; of
    rows that share a doc_id, the text with the smallest hash is taken.  A text that doesn't fit into what is left of the bytes is passed over.
    The ids are bounded, so they are broadcast, and the documents are read once; one row for each id is shuffled.
    """
    open_rows = labels.where(~held_out & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("__y"))
    agreed = open_rows.groupBy("doc_id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").drop("__z")
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    ids = agreed.where("__y = 0").orderBy(order, "doc_id").limit(per_class).union(agreed.where("__y = 1").orderBy(order, "doc_id").limit(per_class))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", "__y").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), F.col("__text"))).alias("__text"))
    rows = keep(one.select("doc_id", "__y", "__text", F.octet_length("__text").alias("__n"), order.alias("__order")), "labelled")
    left, taken = {0: per_class_bytes, 1: per_class_bytes}, []
    for r in sorted(rows.select("doc_id", "__y", "__n", "__order").collect(), key=lambda r: (r["__order"], r["doc_id"])):
        if r["__n"] <= left[r["__y"]]:
            left[r["__y"]] -= r["__n"]
            taken.append(r["doc_id"])
    got = rows.where(F.col("doc_id").isin(taken)).select("doc_id", "__text", "__y").collect() if taken else []
    got.sort(key=lambda r: r["doc_id"])
    return [r["__text"] for r in got], [r["__y"] for r in got]


def remainder(divisor: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``rest``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))
