"""The archive of cells: dated folders, a side table of anomalies, and compaction of single days in place.

    <kind>/batch_id=7/window_date=2024-01-05        what a batch brought; a replay overwrites it
    <kind>-compacted/v=3/window_date=2024-01-05     the newest rows of a day up to some batch
    manifest/0000000003.json                        for each compacted day its version and the last batch in it

``<kind>`` is ``rows`` or ``anomalies``.  A reader takes the newest manifest and, for its days, one
compacted folder and the batches after it, so it never sees half of a compaction, and what arrives meanwhile is read beside it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType, TimestampType

from fieldstream.schemas import ARCHIVE
from fieldstream.sources.tables import ARCHIVE_KEY

KINDS = ("rows", "anomalies")
STORED = StructType([*ARCHIVE.fields, StructField("ingested_at", TimestampType())])
DATED = [StructField("batch_id", LongType()), StructField("window_date", DateType())]


def in_days(column: str, start: str | None, end: str | None) -> Column:
    """Whether a date can hold a time in [start, end]; reads partitions only."""
    ok = F.lit(True)
    if start:
        ok = ok & (F.col(column) >= F.to_date(F.lit(start).cast("timestamp")))
    if end:
        ok = ok & (F.col(column) <= F.to_date(F.lit(end).cast("timestamp")))
    return ok


class Archive:
    """Cells by (geohash, window_start): the row of the last batch counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files

    def _at(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, below: str) -> list[str]:
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def batches(self, kind: str = "rows") -> list[int]:
        return sorted(int(n.removeprefix("batch_id=")) for n in self._names(kind) if n.startswith("batch_id="))

    def manifest(self) -> dict:
        """The newest manifest: its version, and for each day the version that holds it and the last batch in that."""
        found = [n for n in self._names("manifest") if n.endswith(".json") and not n.startswith(".")]
        if not found:
            return {"version": 0, "days": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{found[-1]}", wholetext=True).first().value
        return json.loads(text)

    def _swap(self, manifest: dict) -> None:
        """Make a manifest the newest one: written under another name and renamed, which fails if that version is there."""
        name = f"{manifest['version']:010}.json"
        fs, final, draft = self._fs(), self._at(f"manifest/{name}"), self._at(f"manifest/.{name}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another compaction made version {manifest['version']}")

    # writing

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """One batch of archive rows.  The side table gets its anomalies, and the rows that were anomalies before and no longer are."""
        dated = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ARCHIVE.fields))
        dated = dated.withColumn("ingested_at", F.current_timestamp()).withColumn("window_date", F.to_date("window_start"))
        self._put(dated, f"rows/batch_id={batch_id}")
        # as it is stored, so that both tables agree
        mine = self.spark.read.schema(StructType([*STORED.fields, DATED[1]])).parquet(f"{self.path}/rows/batch_id={batch_id}")
        ends = mine.agg(F.min("window_start").alias("low"), F.max("window_start").alias("high")).first()
        if ends.low is None:
            return
        known = self.read(str(ends.low), str(ends.high), "anomalies", before=batch_id).where("anomaly").select(*ARCHIVE_KEY)
        over = mine.where(~F.coalesce("anomaly", F.lit(False))).join(known, list(ARCHIVE_KEY), "left_semi")
        self._put(mine.where("anomaly").unionByName(over), f"anomalies/batch_id={batch_id}")

    def _put(self, dated: DataFrame, below: str) -> None:
        dated.sortWithinPartitions("window_date", "geohash").write.mode("overwrite").partitionBy("window_date").parquet(f"{self.path}/{below}")

    # reading

    def read(self, start: str | None = None, end: str | None = None, kind: str = "rows", before: int | None = None) -> DataFrame:
        """The newest row of each key with window_start in [start, end], with batch_id and window_date; only folders of these days are opened.

        Of ``anomalies``, rows with ``anomaly`` false are those that no longer are.  ``before`` leaves out later batches.
        """
        days = self.manifest()["days"]
        ids = [b for b in self.batches(kind) if before is None or b < before]
        parts = []
        if ids:
            base = self.spark.read.schema(StructType([*STORED.fields, *DATED])).option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/batch_id={b}" for b in ids))
            upto = F.lit(-1).cast("long")
            if days:
                held = F.create_map(*(F.lit(x) for d, v in days.items() for x in (d, v["upto"])))
                upto = F.coalesce(F.try_element_at(held, F.col("window_date").cast("string")), upto)
            parts.append(base.where(in_days("window_date", start, end) & (F.col("batch_id") > upto)))
        if days:
            folders = [f for d, v in days.items() if self._fs().exists(self._at(f := f"{kind}-compacted/v={v['version']}/window_date={d}"))]
            if folders:
                whole = self.spark.read.schema(StructType([*STORED.fields, *DATED])).option("basePath", f"{self.path}/{kind}-compacted").parquet(*(f"{self.path}/{f}" for f in folders))
                parts.append(whole.where(in_days("window_date", start, end)).select(*(f.name for f in (*STORED.fields, *DATED))))
        if not parts:
            return self.spark.createDataFrame([], StructType([*STORED.fields, *DATED]))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        for text, test in ((start, F.col("window_start").__ge__), (end, F.col("window_start").__le__)):
            if text:
                rows = rows.where(test(F.lit(text).cast("timestamp")))
        newest = Window.partitionBy(*ARCHIVE_KEY, "window_date").orderBy(F.col("batch_id").desc())  # the date follows from the key; named, so that a filter on it is pushed down
        return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")

    def anomalies(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The rows of ``read`` that are anomalies, from the side table alone."""
        return self.read(start, end, "anomalies").where("anomaly")

    # compaction

    def compact(self, days: Iterable[str]) -> int:
        """Bring the batches of some days (ISO dates) that are there now into one folder each; the new version."""
        old, days = self.manifest(), sorted(set(days))
        version, upto = old["version"] + 1, max(self.batches(), default=-1)
        for kind in KINDS:
            rows = self.read(days[0], f"{days[-1]} 23:59:59.999999", kind, before=upto + 1).where(F.col("window_date").cast("string").isin(days))
            rows.repartition("window_date").sortWithinPartitions("window_date", "geohash").write.mode("overwrite").partitionBy("window_date").parquet(f"{self.path}/{kind}-compacted/v={version}")
        self._swap({"version": version, "days": old["days"] | {d: {"version": version, "upto": upto} for d in days}})
        return version

    def vacuum(self) -> int:
        """Delete folders of days that the newest manifest has replaced, once no reader holds an older one; how many."""
        days, gone = self.manifest()["days"], 0
        for kind in KINDS:
            old = [f"{kind}/batch_id={b}/window_date={d}" for b in self.batches(kind) for d, v in days.items() if b <= v["upto"]]
            old += [f"{kind}-compacted/{v}/{n}" for v in self._names(f"{kind}-compacted") for n in self._names(f"{kind}-compacted/{v}") if (d := n.removeprefix("window_date=")) in days and v != f"v={days[d]['version']}"]
            gone += sum(self._fs().delete(self._at(f), True) for f in old)
        return gone
