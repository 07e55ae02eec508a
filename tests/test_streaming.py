import json
import os
import time

import pytest
from pyspark.sql import functions as F

from fieldstream.operators import alerts as A
from fieldstream.operators import cells as C
from fieldstream.operators import clean as Q
from fieldstream.operators import ingest as I
from fieldstream.operators import insights as H
from fieldstream.operators import views as V
from fieldstream.sources import tables as S
from fieldstream.sources.archive import Archive
from fieldstream.streaming import jobs as J


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    for k, v in J.SETTINGS.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def message(k, t, cpm, sensor="s1", lat=35.6895, lon=139.6917):
    return json.dumps({"sensor_id": sensor, "captured_at": f"2026-06-19T01:{t // 60:02d}:{t % 60:02d}Z", "uploaded_at": f"2026-06-19T02:{t // 60:02d}:{t % 60:02d}Z", "latitude": lat, "longitude": lon, "cpm": cpm, "unit": "cpm", "md5sum": f"m{k}"})


def run(stream, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    q = q.start() if checkpoint is None else q.option("checkpointLocation", checkpoint).start()
    assert q.awaitTermination(120), q.stop()
    return q


def put(path, batches):
    """One file for each batch, with times that rise: a stream of files reads them in the order of their times."""
    path.mkdir()
    for k, rows in enumerate(batches):
        file = path / f"{k}.txt"
        file.write_text("\n".join(rows) + "\n")
        os.utime(file, (1_780_000_000 + 10 * k, 1_780_000_000 + 10 * k))
    return str(path)


def test_clean_and_cells_equal_batch(spark, tmp_path):
    rows = [message(k, 7 * k, 50 * k + 10) for k in range(60)]
    src = put(tmp_path / "raw", [[*rows[:30], rows[3], "garbage", "null"], [*rows[30:], rows[31]], [message(99, 3000, 5)], [message(98, 3001, 5)]])
    stream = J.cells(Q.with_class(J.clean_events(J.read_json_folder(spark, src))), late=None)
    run(stream, "cells", None)
    got = {(r.window_start, r["count"], r.cpm_avg) for r in spark.table("cells").collect()}
    batch = C.cell_windows(Q.with_class(Q.parse(spark.createDataFrame([(r,) for r in rows], "value string"))))
    want = {(r.window_start, r["count"], r.cpm_avg) for r in batch.collect()}
    assert got == want


def test_repeats_by_clock(spark, tmp_path):
    src = put(tmp_path / "raw", [[message(1, 1, 5), message(1, 1, 5), message(2, 2, 6)], [message(1, 1, 5), message(3, 3, 7)]])
    run(J.clean_events_by_clock(J.read_json_folder(spark, src)), "clocked", None)
    assert sorted(r.md5sum for r in spark.table("clocked").collect()) == ["m1", "m2", "m3"]


def again(stream, name, tmp_path):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120), q.stop()
    return q


def test_repeats_are_forgotten(spark, tmp_path):
    """A checksum that was met longer ago than the state lives is new again."""
    src = tmp_path / "raw"
    put(src, [[message(1, 1, 5), message(2, 2, 6)]])
    stream = lambda ttl: J.clean_events_by_clock(J.read_json_folder(spark, str(src)), ttl)
    for name, ttl, want in (("long", 3_600_000, ["m1", "m2"]), ("short", 1000, ["m1", "m1", "m2"])):
        again(stream(ttl), name, tmp_path)
        time.sleep(1.5)
        (src / f"{name}.txt").write_text(message(1, 1, 5) + "\n")
        again(stream(ttl), name, tmp_path)
        (src / f"{name}.txt").unlink()
        assert sorted(r.md5sum for r in spark.read.parquet(str(tmp_path / name)).collect()) == want


def test_mobility_equals_batch(spark, tmp_path):
    rows = [message(k, k, 5, sensor="still" if k % 2 else "moves", lat=35.0 + (k % 3) * 1e-5 + (0.001 * (k > 12) * (1 - k % 2)), lon=139.0) for k in range(40)]
    src = put(tmp_path / "raw", [rows[:10], rows[10:14], rows[14:]])
    events = Q.parse(J.read_json_folder(spark, src)).drop("sensor_type")
    again(J.mobility(events, least_m=50.0), "tagged", tmp_path)
    got = {(r.md5sum, r.sensor_type) for r in spark.read.parquet(str(tmp_path / "tagged")).collect()}
    batch = I.tag_mobility(Q.parse(spark.createDataFrame([(r,) for r in rows], "value string")), ["uploaded_at"], 50.0)
    assert got == {(r.md5sum, r.sensor_type) for r in batch.collect()} and {t for _, t in got} == {"mobile", "fixed"}


def test_counters(spark, tmp_path):
    src = put(tmp_path / "raw", [[message(1, 100, 5), message(2, 2, 6), "garbage"], [message(3, 3000, 7), "[1]"], [message(4, 1, 8)], [message(5, 3001, 9)]])
    counters = J.Counters()
    spark.streams.addListener(counters)
    try:
        events = J.clean_events(H.observed_messages(J.read_json_folder(spark, src), "raw"))
        run(C.cell_windows(Q.with_class(H.observed(events, "clean"))), "counted", None)
        deadline = time.time() + 20
        while counters.totals.get("consumed", 0) < 7 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals["consumed"] == 7 and counters.totals["malformed"] == 2 and counters.totals["bytes"] > 500
    assert counters.totals["late"] >= 1 and counters.totals["errors"] == 0 and counters.last_event is not None


def test_counters_over_restarts(spark, tmp_path):
    """Sent, discarded, malformed and bytes of two runs, kept as a table; a run that saves twice counts once."""
    src, cp, kept = put(tmp_path / "raw", [[message(1, 1, 5), "garbage", message(2, 2, -1)]]), str(tmp_path / "cp"), str(tmp_path / "counts")
    ok = lambda text: text.replace(': "m', ': "' + "a" * 31)  # noqa: E731  a checksum of 32 digits

    def go(run_id):
        counters = J.Counters()
        spark.streams.addListener(counters)
        try:
            judged = Q.decode(H.observed_messages(J.read_json_folder(spark, src), f"in{run_id}")).withColumn("discard_reason", Q.discard_reason(F.col("event"), F.col("value")))
            sent = S.keyed(S.observed_delivery(judged, f"out{run_id}").select("event.*"))
            q = sent.writeStream.format("parquet").option("path", str(tmp_path / "sent")).option("checkpointLocation", cp).trigger(availableNow=True).start()
            assert q.awaitTermination(120), q.stop()
            deadline = time.time() + 20
            while not counters.totals.get("consumed") and time.time() < deadline:
                time.sleep(0.2)
        finally:
            spark.streams.removeListener(counters)
        for _ in range(2):
            counters.save(spark, kept, run_id)

    go("a")
    (tmp_path / "raw" / "1.txt").write_text("\n".join([ok(message(3, 3, 7)), ok(message(4, 4, 8)), "[1]"]) + "\n")
    go("b")
    r = J.run_totals(spark, kept).first()
    assert (r.runs, r.sent, r.discarded, r.malformed, r.errors, r.late) == (2, 2, 4, 2, 0, 0) and r.bytes > 500 and 0 < r.per_second < 100
    assert spark.read.parquet(str(tmp_path / "sent")).count() == 2


def test_settings_and_state_on_disk(spark, tmp_path):
    """Settings of a job, and its state read back from the checkpoint."""
    folder = str(tmp_path / "checkpoints")
    run_as = J.Running.of({"CHECKPOINT_DIR": folder + "/", "CHECKPOINT_INTERVAL_MS": "5000", "CHECKPOINT_CHANGELOG": " ", "CHECKPOINT_KEPT": "7"})
    assert run_as == J.Running(folder, 5.0, True, 7)
    for bad in ({}, {"CHECKPOINT_DIR": " "}, {"CHECKPOINT_DIR": "x", "CHECKPOINT_INTERVAL_MS": "0"}):
        with pytest.raises(ValueError):
            J.Running.of(bad)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "spark.sql.streaming.minBatchesToRetain")}
    run_as.apply(spark)
    try:
        df = cell_rows(spark, MEANS[:5])
        df.coalesce(1).write.parquet(str(tmp_path / "cells"))
        writer = J.scored(spark.readStream.schema(df.schema).parquet(str(tmp_path / "cells"))).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q = run_as.start(writer, "scored", once=True)
        assert q.awaitTermination(120), q.stop()
        assert q.name == "scored" and any(name.endswith(".changelog") for _, _, names in os.walk(run_as.place("scored")) for name in names)
        state = spark.read.format("statestore").option("stateVarName", "last").load(run_as.place("scored")).collect()
        assert [(r.key[0], list(r.value.means if "means" in r.value else r.value.value.means)) for r in state] == [("xn774", [10.0, 12.0, 11.0, 40.0])]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_configuration_topic_reaches_the_running_job(spark, tmp_path):
    """Malformed and invalid messages leave the last good configuration in force; a later good one takes over."""
    whole = lambda warn, danger, **more: json.dumps({"cpm_warn_threshold": warn, "cpm_danger_threshold": danger, **more})
    topics, log = tmp_path / "config", str(tmp_path / "log")
    put(topics, [[whole(10, 50)], ["garbage", whole(90, 20), '{"cpm_warn_threshold": 1}']])
    put(tmp_path / "raw", [[message(1, 1, 60)]])

    def both():
        q = J.write_config_log(J.read_json_folder(spark, str(topics)), log, str(tmp_path / "cp1")).trigger(availableNow=True).start()
        assert q.awaitTermination(120), q.stop()
        q = J.write_clean(J.clean_events(J.read_json_folder(spark, str(tmp_path / "raw"))), lambda: J.config_versions(spark, log), str(tmp_path / "clean"), str(tmp_path / "cp2")).trigger(availableNow=True).start()
        assert q.awaitTermination(120), q.stop()

    assert J.config_versions(spark, log).count() == 0
    both()
    (topics / "2.txt").write_text(whole(100, 1000, area={"min_lat": 0, "max_lat": 1, "min_lon": 0, "max_lon": 1}) + "\n")
    (tmp_path / "raw" / "1.txt").write_text(message(2, 2, 60) + "\n")
    both()
    got = spark.read.parquet(str(tmp_path / "clean"))
    assert sorted((r.md5sum, r.classification, r.in_region) for r in got.collect()) == [("m1", "DANGER", True), ("m2", "SAFE", False)]


def test_delivery(spark, tmp_path):
    rows = [("clean", "s1", 1), ("clean", "s1", 2), ("alert", "s1", 3), ("aggregated", "s1", 4), ("clean", "s2", 5), ("alert", "s2", 6), ("clean", "s1", 7)]
    path = str(tmp_path / "in")
    df = spark.createDataFrame([(*r, f"d{r[2]}") for r in rows], "type string, key string, order long, data string")
    df.coalesce(1).write.parquet(path)
    J.write_delivery(spark.readStream.schema(df.schema).parquet(path), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.lane, r.data) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("lane", "order").collect()] == [(0, "d3"), (0, "d6"), (1, "d4"), (1, "d5"), (1, "d7")]


def view_messages(spark):
    """(type, key, order, data, latitude, longitude, time) in three batches."""
    row = lambda kind, key, n, lat=1.0: (kind, key, n, f"d{n}", lat, 1.0, "2026-06-19T01:00:00Z")
    first = [row("clean", "s1", 1), row("clean", "s2", 2), row("alert", "s1", 3), row("aggregated", "g1", 4), row("clean", "s1", 5), row("alert", "s2", 6, 50.0)]
    second = [row("clean", "s3", 7), row("alert", "s3", 8), row("alert", "s4", 9), row("other", "x", 10), row("clean", "s2", 11), row("clean", "s4", 12, 50.0)]
    return [first, second, [row("clean", "s9", 13)]], "type string, key string, order long, data string, latitude double, longitude double, time string"


def test_delivery_with_pending_state(spark, tmp_path):
    """Two batches wait for one flush: keys are replaced, alerts queue, caps of 3 drop the oldest, each client has its view."""
    batches, schema = view_messages(spark)
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    views = {"all": V.View(), "south": V.View(H.Box(0.0, 10.0, 0.0, 10.0)), "later": V.View(start="2026-06-19T02:00:00Z", end="2026-06-20")}

    def go(rows, flush_s):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = J.deliver(spark.readStream.schema(schema).parquet(src), views, flush_s, most_alerts=3, most_keys=3)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        assert q.awaitTermination(120), q.stop()
        return [r.asDict() for r in spark.read.schema(stream.schema).parquet(out).collect()]

    assert go(batches[0], 3600.0) == [] and go(batches[1], 3600.0) == []
    rows = go(batches[2], 0.001)  # what waited is due now
    mine = lambda client, flush=1: sorted((r["lane"], r["order"]) for r in rows if (r["client"], r["flush"]) == (client, flush))
    counts = lambda client, flush=1: {(r["replaced"], r["dropped"], r["filtered"]) for r in rows if (r["client"], r["flush"]) == (client, flush)}
    # alerts 3 and 6 go from the queue, and s2, g1, s1, s3 from the keys, the ones that changed longest ago
    assert mine("all") == [(0, 8), (0, 9), (0, 10), (1, 11), (1, 12), (1, 13)] and counts("all") == {(1, 6, 0)}
    assert mine("south") == [(0, 8), (0, 9), (0, 10), (1, 7), (1, 11), (1, 13)] and counts("south") == {(1, 4, 2)}
    assert mine("later") == [(0, 10)] and counts("later") == {(0, 0, 12)}  # a type without known fields passes every view
    # a flushed message does not come again
    last = [("clean", "s1", 20, "d20", 1.0, 1.0, None), ("clean", "s1", 21, "d21", 1.0, 1.0, "never")]
    go(last, 1.0)
    time.sleep(1.5)
    rows = go([("other", None, 22, "d22", 1.0, 1.0, None)], 1.0)
    assert mine("all", 2) == [(0, 22), (1, 21)] and mine("later", 2) == [(0, 22), (1, 21)] and {r["flush"] for r in rows} == {1, 2}


def test_quarantine_survives_a_replay(spark, tmp_path):
    """Poison records end in quarantine once each, with their reason, though the last batch runs twice."""
    poison = ["garbage", "null", "[1]", message(90, 1, -5), message(91, 1, 5).replace('"s1"', '""'), message(92, 1, 5).replace("2026-06-19T01:00:01Z", "12:30"), message(93, 1, "x")]
    src, out, cp = put(tmp_path / "raw", [[message(1, 1, 5), *poison[:3]], [message(2, 2, None), *poison[3:]]]), str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        q = J.write_checked(J.read_json_folder(spark, src), out, cp).trigger(availableNow=True).start()
        assert q.awaitTermination(120), q.stop()
        bad = sorted((r.value, r.discard_reason) for r in spark.read.parquet(f"{out}/quarantine").collect())
        return bad, sorted(r.md5sum for r in spark.read.parquet(f"{out}/valid").collect()), {(r.reason, r.batch_id): r.messages for r in spark.read.parquet(f"{out}/reasons").collect()}

    first = go()
    reasons = ["not an object"] * 3 + ["cpm out of range", "missing field", "schema violation", "cpm not numeric"]
    # checksums of the test messages aren't hexadecimal, so no message is valid but for its md5sum
    assert first[0] == sorted([*zip(poison, reasons, strict=True), *((message(k, k, c), "schema violation") for k, c in ((1, 5), (2, None)))]) and first[1] == []
    assert sum(first[2].values()) == 9 and first[2]["not an object", 0] == 3
    os.remove(f"{cp}/commits/1")
    for crc in (tmp_path / "cp" / "commits").glob(".1.crc"):
        crc.unlink()
    assert go() == first


def test_cells_reach_the_archive(spark, tmp_path):
    """The job cells -> archive, with a replay of its last batch; its rows are those of the batch operators."""
    df = cell_rows(spark, MEANS)
    src, cp, path = str(tmp_path / "cells"), str(tmp_path / "cp"), str(tmp_path / "archive")
    for part in (df.where("k < 7"), df.where("k >= 7")) if "k" in df.columns else (df.orderBy("window_start").limit(7), df.orderBy("window_start").offset(7)):
        part.coalesce(1).write.mode("append").parquet(src)
        q = J.write_archive(J.scored(spark.readStream.schema(df.schema).parquet(src)), path, cp).trigger(availableNow=True).start()
        assert q.awaitTermination(120), q.stop()
    os.remove(f"{cp}/commits/1")
    for crc in (tmp_path / "cp" / "commits").glob(".1.crc"):
        crc.unlink()
    q = J.write_archive(J.scored(spark.readStream.schema(df.schema).parquet(src)), path, cp).trigger(availableNow=True).start()
    assert q.awaitTermination(120), q.stop()
    pick = lambda d: sorted((r.window_start, r["count"], r.cpm_zscore or -1, r.anomaly) for r in d.collect())
    archive = Archive(spark, path)
    assert pick(archive.read()) == pick(C.rolling(df)) and archive.batches() == [0, 1]
    assert pick(archive.anomalies()) == [r for r in pick(C.rolling(df)) if r[3]] != []


def cell_rows(spark, means):
    rows = [(k, m) for k, m in enumerate(means)]
    df = spark.createDataFrame(rows, "k long, cpm_avg double").withColumn("window_start", F.timestamp_seconds(F.lit(1_780_000_000) + 60 * F.col("k"))).withColumn("window_end", F.timestamp_seconds(F.lit(1_780_000_060) + 60 * F.col("k")))
    return df.select(
        F.lit("xn774").alias("geohash"), F.lit(5).alias("precision"), "window_start", "window_end", F.lit(3).cast("long").alias("count"), "cpm_avg", F.col("cpm_avg").alias("cpm_max"), F.col("cpm_avg").alias("cpm_min"),
        F.struct(F.lit(1).cast("long").alias("SAFE"), F.lit(1).cast("long").alias("WARN"), F.lit(1).cast("long").alias("DANGER")).alias("class_counts"), F.lit("SAFE").alias("worst_classification"), F.lit(35.0).alias("centroid_latitude"), F.lit(139.0).alias("centroid_longitude"),
    )


MEANS = [10.0, 12.0, 11.0, 40.0, None, 13.0, 12.5, 60.0, 11.0, 20.0, 30.0, 41.0, 52.0, 63.0]


def test_rolling_survives_restarts_and_equals_batch(spark, tmp_path):
    df = cell_rows(spark, MEANS)
    path, schema = str(tmp_path / "cells"), df.schema
    for k in range(len(MEANS)):  # every batch is a restart on the same checkpoint
        df.orderBy("window_start").offset(k).limit(1).coalesce(1).write.mode("append").parquet(path)
        stream = J.scored(spark.readStream.schema(schema).parquet(path))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start() if k in (4, 9, 13) else None
        if q:
            assert q.awaitTermination(120), q.stop()
    pick = lambda d: sorted((r.window_start, r.rolling_cpm_avg, r.cpm_zscore, r.anomaly) for r in d.collect())
    got = pick(spark.read.parquet(str(tmp_path / "out")).fillna(-1.0))
    assert got == pick(C.rolling(df).fillna(-1.0)) and any(g[3] for g in got)


def test_trends_equal_batch(spark, tmp_path):
    df = cell_rows(spark, MEANS)
    path = str(tmp_path / "cells")
    df.coalesce(1).write.parquet(path)
    run(J.trends(spark.readStream.schema(df.schema).parquet(path)), "rising", None)
    got = sorted((r.window_start, r.cpm_series, r.delta) for r in spark.table("rising").collect())
    want = sorted((r.window_start, r.trend.cpm_series, r.trend.delta) for r in A.rising_trends(df).collect())
    assert got == want and len(got) >= 2


def test_sustained_and_regional(spark, tmp_path):
    rows = [message(k, 20 * k, 1500 + k) for k in range(40)]
    src = put(tmp_path / "raw", [rows[:20], rows[20:], [message(99, 3500, 5)], [message(98, 3501, 5)]])
    run(J.sustained(Q.with_class(J.clean_events(J.read_json_folder(spark, src))), cooldown_s=600, late=None), "sustained", None)
    got = sorted(spark.table("sustained").select("window_end").collect())
    batch = Q.with_class(Q.parse(spark.createDataFrame([(r,) for r in rows], "value string"))).withColumn("seq", F.lit(0))
    want = sorted(A.cooldown(A.sustained_high(batch)).select("window_end").collect())
    assert got == want and len(got) >= 1

    cells, alerts = cell_rows(spark, [10.0, 20.0]), cell_rows(spark, [1.0]).select("window_end", F.lit("s1").alias("sensor_id"), F.lit(35.6895).alias("latitude"), F.lit(139.6917).alias("longitude"))
    cells.coalesce(1).write.parquet(str(tmp_path / "c"))
    alerts.withColumn("window_end", F.col("window_end") + F.expr("interval 1 hour")).coalesce(1).write.parquet(str(tmp_path / "a"))
    stream = J.regional(spark.readStream.schema(alerts.schema).parquet(str(tmp_path / "a")), spark.readStream.schema(cells.schema).parquet(str(tmp_path / "c")))
    run(stream, "regional", None)
    (r,) = spark.table("regional").collect()
    assert json.loads(r.hot_region)["cpm_avg"] == 20.0 and json.loads(r.alert)["sensor_id"] == "s1"


def alert_rows(df):
    return sorted(str(r.asDict(True)) for r in df.collect())


def test_raw_to_alerts_in_one_query(spark, tmp_path):
    """Raw messages to alerts of both kinds in the contract's form, with a restart in the middle: the rows of the batch operators, each once."""
    rows = []
    for k in range(240):  # two sensors near each other, one in another cell whose means rise, then fall
        t = 10 * k
        rows.append(message(f"a{k}", t, 1500 + k % 7 if k % 100 < 60 else 20, sensor="s1"))
        if k % 2:
            rows.append(message(f"b{k}", t + 1, 1200 + k if 40 < k < 90 else 30, sensor="s2", lat=35.69, lon=139.70))
        rows.append(message(f"c{k}", t + 2, 10 + (k // 6 % 5) * 8, sensor="s3", lat=48.1, lon=11.5))
    parts = [[*rows[:300], rows[7], "junk"], [*rows[300:], rows[360]], [message("z1", 3500, 5)], [message("z2", 3501, 5)]]
    src, out, cp = put(tmp_path / "raw", parts), str(tmp_path / "out"), str(tmp_path / "cp")
    files = sorted(os.listdir(src))
    held = tmp_path / "held"
    held.mkdir()
    for f in files[1:]:
        os.rename(f"{src}/{f}", held / f)

    def go():
        alerts = J.alert_stream(Q.with_class(J.clean_events(J.read_json_folder(spark, src))))
        q = alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        assert q.awaitTermination(300), q.stop()

    go()
    for f in files[1:]:
        os.rename(held / f, f"{src}/{f}")
    go()
    got = spark.read.parquet(out)
    assert got.schema.simpleString() == J.ALERT.simpleString()

    batch = Q.with_class(Q.first_of_repeats(Q.parse(spark.createDataFrame([(r,) for part in parts for r in part], "value string")), ["uploaded_at"])).withColumn("tie", F.xxhash64("md5sum", "uploaded_at"))
    closed = lambda df: df.where("window_end <= timestamp '2026-06-19 01:57:50'")  # noqa: E731  the last watermark
    cell_df = C.cell_windows(batch)
    want = A.all_alerts(A.with_region(A.cooldown(A.sustained_high(batch, tie="tie")), cell_df), A.rising_trends(cell_df))
    names = [f.name for f in J.ALERT.fields]
    assert alert_rows(got) == alert_rows(closed(want).select(names))
    kinds = {(r.reason, r.hot_region is not None, r.trend is not None) for r in got.collect()}
    assert kinds == {("sustained-high", True, False), ("rising-trend", False, True)} and got.count() >= 6


def test_console_line_and_envelope(spark):
    clean = spark.createDataFrame([("s1", "2026-06-19 01:00:05", 12.5, "SAFE", 35.68951, 139.0)], "sensor_id string, captured_at string, cpm double, classification string, latitude double, longitude double")
    assert clean.select(S.console_line().alias("l")).first().l == "2026-06-19 01:00:05 s1 cpm=12.5 SAFE (35.6895, 139.0000)"
    rows = [("radiation.clean", '{"a":1}'), ("radiation.alerts", "junk"), ("other", "{}")]
    q = S.envelope(H.observed_messages(spark.createDataFrame(rows, "topic string, value string"), "seen"))
    assert [(r.type, r.data) for r in q.collect()] == [("clean", '{"a":1}')]


def test_clean_job_uses_the_current_configuration(spark, tmp_path):
    src = put(tmp_path / "raw", [[message(1, 1, 60), message(2, 2, 700)]])
    versions = spark.createDataFrame([(1, 50.0, 500.0, None, None)], "version long, warn double, danger double, area struct<min_lat: double, max_lat: double, min_lon: double, max_lon: double>, timespan struct<start: timestamp, end: timestamp>")
    for _ in range(2):
        J.write_clean(J.clean_events(J.read_json_folder(spark, src)), lambda: versions, str(tmp_path / "clean"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "clean"))
    assert sorted((r.md5sum, r.classification, r.in_region) for r in got.collect()) == [("m1", "WARN", True), ("m2", "DANGER", True)]
