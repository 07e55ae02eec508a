import re
import threading

import pytest
from pyspark.sql import functions as F

from fieldstream.operators import insights as H
from fieldstream.sources import tables as S
from fieldstream.sources.archive import Archive

KEYS = [(g, d, h) for g in "abcd" for d in range(1, 7) for h in (0, 9, 23)]


def batch(spark, rows):
    """rows: (geohash, day, hour, count, anomaly)."""
    df = spark.createDataFrame(rows, "geohash string, day int, hour int, count long, anomaly boolean")
    at = F.make_timestamp(F.lit(2024), F.lit(1), "day", "hour", F.lit(0), F.lit(0))
    return df.select("geohash", at.alias("window_start"), (at + F.expr("interval 1 hour")).alias("window_end"), "count", "anomaly", F.lit(1.0).alias("cpm_avg"), F.lit(2.0).alias("cpm_max"))


def rows_of(df):
    return sorted((r.geohash, r.window_start.day, r.window_start.hour, r["count"], r.anomaly) for r in df.collect())


def newest(*batches):
    found = {}
    for b in batches:
        found |= {r[:3]: r for r in b}
    return sorted(found.values())


def files_read(df):
    """The plan that ran, and how many files it opened."""
    df.collect()

    def count(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return count(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return count(node.plan())
        below = node.children()
        return (node.metrics().apply("numFiles").value() if kind == "FileSourceScanExec" else 0) + sum(count(below.apply(k)) for k in range(below.size()))

    plan = df._jdf.queryExecution().executedPlan()
    return plan.toString(), count(plan)


@pytest.fixture
def two(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    first = [(*k, 1, k[0] == "a") for k in KEYS]
    second = [(*k, 2, k[0] == "b" and k[2] == 9) for k in KEYS if k[1] in (3, 4) and k[2] < 20]
    for k, rows in enumerate((first, second)):
        archive.append(batch(spark, rows), k)
    archive.append(batch(spark, second), 1)  # a replay
    return archive, first, second


def test_reads_and_prunes(spark, two):
    archive, first, second = two
    want = newest(first, second)
    assert rows_of(archive.read()) == want and rows_of(archive.anomalies()) == [r for r in want if r[4]]
    some = archive.read("2024-01-03 05:00:00", "2024-01-04T12:00:00")
    assert rows_of(some) == [r for r in want if (3, 5) <= r[1:3] <= (4, 12)]
    plan, opened = files_read(some)
    assert re.search(r"PartitionFilters: \[[^\]]*window_date", plan)
    every = [f for f in some.inputFiles() if "rows" in f]
    assert opened == len([f for f in every if "2024-01-03" in f or "2024-01-04" in f]) < files_read(archive.read())[1] == len(every)
    # the side table has no files but of days with anomalies
    odd = archive.anomalies("2024-01-03", "2024-01-03 23:00:00")
    assert files_read(odd)[1] == len([f for f in odd.inputFiles() if "2024-01-03" in f]) and all("/anomalies/" in f for f in odd.inputFiles())


def test_compaction_while_a_batch_arrives(spark, two, monkeypatch):
    """One day is compacted while the next batch comes in; nothing is lost, doubled or seen half."""
    archive, first, second = two
    third = [(*k, 3, False) for k in KEYS if k[1] in (3, 5)]
    before, swap = newest(first, second), Archive._swap

    def late(self, manifest):
        # all files of the new version are there, the manifest isn't
        assert rows_of(Archive(spark, self.path).read()) == before
        t = threading.Thread(target=lambda: archive.append(batch(spark, third), 2))
        t.start()
        t.join()
        swap(self, manifest)

    monkeypatch.setattr(Archive, "_swap", late)
    assert archive.compact(["2024-01-03"]) == 1
    monkeypatch.undo()
    want = newest(first, second, third)
    assert rows_of(archive.read()) == want and rows_of(archive.anomalies()) == [r for r in want if r[4]]
    assert archive.manifest()["days"] == {"2024-01-03": {"version": 1, "upto": 1}}
    archive.compact(["2024-01-03", "2024-01-06"])
    assert rows_of(archive.read()) == want and rows_of(archive.anomalies()) == [r for r in want if r[4]]
    assert files_read(archive.read("2024-01-03", "2024-01-03 23:59:59"))[1] == 1
    assert archive.vacuum() > 0 and archive.vacuum() == 0
    assert rows_of(archive.read()) == want and rows_of(archive.anomalies()) == [r for r in want if r[4]]
    archive.append(batch(spark, [("a", 3, 0, 9, True)]), 3)
    assert rows_of(archive.read()) == newest(want, [("a", 3, 0, 9, True)])
    with pytest.raises(RuntimeError):
        archive._swap({"version": 2, "days": {}})


def test_empty(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "none"))
    assert archive.read().count() == archive.anomalies("2024-01-01").count() == 0 and archive.manifest()["version"] == 0
    archive.append(batch(spark, []), 0)
    assert archive.read().count() == 0 and tuple(H.summary(archive.read()).first())[:3] == (0, 0, 0)


def test_time_filter_of_insights_prunes(spark, two):
    archive, *_ = two
    some = H.within(archive.read(), start="2024-01-02", end="2024-01-02 10:00:00")
    plan, _ = files_read(some)
    assert re.search(r"PartitionFilters: \[[^\]]*window_date", plan) and rows_of(some) == [(g, 2, h, 1, g == "a") for g in "abcd" for h in (0, 9)]
    assert S.ARCHIVE_KEY == ("geohash", "window_start")
