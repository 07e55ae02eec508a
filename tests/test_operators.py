import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

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


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def bisected(lat, lon, precision):
    """Geohash by halving intervals."""
    lo, hi, bits = [-180.0, -90.0], [180.0, 90.0], []
    for k in range(5 * precision):
        a, x = k % 2, (lon, lat)[k % 2]
        mid = (lo[a] + hi[a]) / 2
        bits.append(x > mid)
        (lo if x > mid else hi)[a] = mid
    return "".join(X.BASE32[sum(b << (4 - i) for i, b in enumerate(bits[k : k + 5]))] for k in range(0, len(bits), 5))


def test_geohash(spark):
    rng = random.Random(0)
    points = [(35.6895, 139.6917), (0.0, 0.0), (-90.0, -180.0), (90.0, 180.0), (45.0, 90.0)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for p in (1, 2, 5, 7):
        got = [r.g for r in df.select(X.geohash(F.col("lat"), F.col("lon"), p).alias("g")).collect()]
        assert got == [bisected(a, b, p) for a, b in points]
    assert bisected(35.6895, 139.6917, 5) == "xn774"
    assert one(spark, X.geohash(F.lit(None).cast("double"), F.lit(1.0))) == (None,)


def test_scalars(spark):
    d = lambda x: F.lit(x).cast("double")
    assert one(spark, *(X.classify(d(x)) for x in (None, 0.0, 99.9, 100.0, 999.0, 1000.0))) == (None, "SAFE", "SAFE", "WARN", "WARN", "DANGER")
    assert one(spark, *(X.plausible(F.lit(x)) for x in ("12.5", "-1", "1000001", "x", "NaN")), X.plausible(F.lit(None).cast("string"))) == (True, False, False, False, False, True)
    assert one(spark, *(X.number(F.lit(x)) for x in (" 1.5 ", "", "n/a"))) == (1.5, None, None)
    times = [X.iso(X.timestamp(F.lit(t))) for t in ("2026-06-19T01:00:05.12345Z", "2026-06-19 01:00:05.123456789", "2026-06-19T03:00:05+02:00", "no", "")]
    assert one(spark, *times) == ("2026-06-19T01:00:05+00:00",) * 3 + (None, None)
    assert abs(one(spark, X.haversine_m(d(0.0), d(0.0), d(0.0), d(1.0)))[0] - 6_371_000 * math.pi / 180) < 1e-6
    assert one(spark, *(X.sensor_of(F.lit(a), F.lit(b)) for a, b in (("s", "d"), (" ", "d"), ("", "0"), ("", " ")))) == ("s", "d", None, None)
    assert one(spark, *(X.track_time(F.lit(10.0), F.lit(20.0), F.lit(f)) for f in (-1.0, 0.25, 3.0))) == (10.0, 12.5, 20.0)


def test_strict_texts(spark):
    """What a plain parser of numbers and ISO times refuses is null, on any day."""
    assert "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) == "".join(sorted(X.WHITE))
    numbers = ["5d", "5f", "0x1p3", "1__0", "_1", "1_", "1_0", "\t7.5\u00a0", "+.5e1", "8.", ".", "1e", "-3E-2", "inf", "-Infinity", "nan", "NaN", "1,5", "", "\u2003", "٣", "1 2"]

    def plain(text):
        try:
            return float(text) if text.isascii() or text.strip().isascii() else None  # digits of other scripts are left out
        except ValueError:
            return None

    got = one(spark, *(X.number(F.lit(x)) for x in numbers))
    assert [repr(g) for g in got] == [repr(plain(x)) for x in numbers]
    assert one(spark, *(X.plausible(F.lit(x)) for x in ("5d", "1_0", "\t7 "))) == (False, True, True)
    bad = ["12:30", "2024", "2024-01", "2024-01-01 5:3", "2024-01-01T05:03 Europe/Paris", "2024-01-01T05:03:04 UTC", "2024-1-1", "2024-13-01", "2024-02-30", "2024-01-01T24:00", "2024-01-01T05:03:", "2024-01-01T05:03:04.", "T05:03", "epoch", "now", "20240101", "0000-01-01", "2024-01-01T05:03+9", "2024-01-01Z"]
    good = ["2024-01-01", "2024-01-01T05", "2024-01-01 05:03", "\t2024-01-01T05:03:04.1234567+09:00\u2003", "2024-01-01T05:03:04Z", "2024-01-01T05-02:30", "2024-02-29T23:59:59.999999"]
    assert one(spark, *(X.timestamp(F.lit(t)) for t in bad)) == (None,) * len(bad)
    got = one(spark, *(F.unix_micros(X.timestamp(F.lit(t))) for t in good))
    assert list(got) == [round(V.instant(t).timestamp() * 1e6) for t in good]
    for t in bad:
        with pytest.raises(ValueError):
            V.View(start=t, end="2099-01-01")
    assert one(spark, *(X.normal_time(F.lit(t)) for t in ("\t2024-01-01 05:03:04Z ", "2024-01-01Z05", "\x1f", "12:30"))) == ("2024-01-01T05:03:04+00:00", "2024-01-01+00:0005", None, "12:30")
    assert one(spark, X.sensor_of(F.lit("\t"), F.lit("77\u3000")), X.sensor_of(F.lit("\x1c"), F.lit("\t0")), X.checked_unit(F.lit("cpm\t")), X.blank_to_null(F.lit("\u2003"))) == ("77", None, "cpm", None)


def test_map_rows(spark):
    names = ["captured_at", "device_id", "sensor_id", "latitude", "longitude", "value", "unit", "height", "location_name", "measurement_import_id"]
    rows = [
        ("2020-06-17T08:02:49.000Z", "100162", "", "35.74591", "139.91815", "9.0", "cpm", "20.0", "", ""), ("", "1", "", "1", "1", "1", "cpm", "", "", ""), ("2020-06-17 08:02:49", "0", " ", "1", "1", "1", "cpm", "", "", ""),
        ("2020-06-17", "1", "", "95", "1", "1", "cpm", "", "", ""), ("2020-06-17T00:00:00", "1", "", "1", "1", "7", "Bq", "", "", "x"),
    ]
    got = I.map_rows(spark.createDataFrame(rows, names)).collect()
    assert [r.reject_reason for r in got] == [None, "no time", "no sensor", "no position", None]
    assert (got[0].sensor_id, got[0].captured_at, got[0].uploaded_at, got[0].cpm, got[0].height, len(got[0].md5sum)) == ("100162", "2020-06-17T08:02:49.000+00:00", "2020-06-17T08:02:49.000+00:00", 9.0, 20.0, 32)
    assert got[4].cpm is None and got[4].unit is None and got[4].loader_id == "x"


def test_validation_reasons(spark):
    ok = '{"sensor_id":"s","captured_at":"2026-06-19T01:00:00Z","uploaded_at":"2026-06-19T01:00:00Z","latitude":1.5,"longitude":2,"cpm":%s}'
    values = [ok % "5", ok % "null", ok % '"7"', ok % '"x"', ok % "-1", ok % "9999999", (ok % "5").replace("1.5", "200"), (ok % "5").replace('"s"', '""'), (ok % "5").replace('"latitude":1.5,', ""), '"text"', "null", "{}", "[]"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, value string")
    valid, bad = Q.split_valid(df)
    reasons = {r.k: r.discard_reason for r in bad.collect()}
    assert sorted(r.k for r in valid.collect()) == [0, 1]
    assert [reasons[k] for k in range(2, 13)] == ["schema violation", "cpm not numeric", "cpm out of range", "cpm out of range", "schema violation", "missing field", "missing field", "not an object", "not an object", "missing field", "not an object"]
    assert sorted(r.cpm is None for r in Q.parse(df).collect())[-1] and Q.parse(df).count() == 8


def test_contract_on_types_and_properties(spark):
    """JSON types, unknown properties, lists and patterns of the fields."""
    whole = {"sensor_id": "s", "captured_at": "2026-06-19T01:00:00Z", "uploaded_at": "2026-06-19T01:00:00Z", "latitude": 1.5, "longitude": 2}
    good = [{}, {"cpm": 21.0, "unit": "cpm"}, {"cpm": None, "height": None, "surface": None, "md5sum": None}, {"classification": "WARN", "sensor_type": "fixed", "md5sum": "0a" * 16, "loader_id": "7", "height": 1e3}]
    bad = [{"captured_at": t} for t in ("12:30", "2024", "2024-01", "2024-01-01 5:3")] + [{"cpm": "7"}, {"latitude": "1.5"}, {"sensor_id": 5}, {"height": "1"}, {"unit": None}, {"unit": "bq"}, {"extra": 1}, {"classification": "HIGH"}, {"sensor_type": "car"}, {"md5sum": "xyz"}, {"location_name": 3}, {"loader_id": True}, {"surface": {"a": 1}}]
    df = spark.createDataFrame([(k, json.dumps(whole | x)) for k, x in enumerate(good + bad)], "k int, value string")
    valid, quarantine = Q.split_valid(df)
    assert sorted(r.k for r in valid.collect()) == list(range(len(good)))
    assert {r.discard_reason for r in quarantine.collect()} == {"schema violation"}


def test_csv_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"Captured Time,Device ID,Location Name,Other\n2026-01-01 00:00:00,1,caf\xe9 \xff,x\n2026-01-02 00:00:00,2,,x\n2026-01-03 00:00:00,3\n")
    rows = S.read_csv(spark, str(tmp_path / "a.csv")).orderBy("captured_at").collect()
    assert [r.location_name for r in rows] == ["caf\ufffd \ufffd", "", ""]
    assert rows[0].asDict().keys() == {"captured_at", "device_id", "location_name"}


def test_csv_skips_rows_over_many_splits(spark, tmp_path):
    path = tmp_path / "many"
    path.mkdir()
    names = [f"d{k:04}" for k in range(1500)]
    for n, part in enumerate((names[:900], names[900:901], names[901:])):
        (path / f"{n}.csv").write_text("Device ID,Other\n" + "".join(f"{d},x\n" for d in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert S.read_csv(spark, str(path)).rdd.getNumPartitions() > 8
        for skip in (0, 1, 777, 899, 900, 901, 1499, 1500, 9000):
            rows = S.read_csv(spark, str(path), skip)
            assert rows.columns == ["device_id"] and sorted(r.device_id for r in rows.collect()) == names[skip:]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def series(spark, means):
    df = spark.createDataFrame(list(enumerate(means)), "k int, cpm_avg double")
    at = lambda k: F.timestamp_seconds(F.lit(1_780_000_000) + 60 * (F.col("k") + k))
    return df.select(F.lit("g").alias("geohash"), at(0).alias("window_start"), at(1).alias("window_end"), "cpm_avg", F.col("cpm_avg").alias("cpm_max"), F.lit(1.0).alias("centroid_latitude"), F.lit(1.0).alias("centroid_longitude"))


def test_rolling(spark):
    z = lambda means: [r.cpm_zscore for r in C.rolling(series(spark, means)).orderBy("window_start").collect()]
    assert z([8.0, 12.0, 16.0])[-1] == 3.0 and z([8.0, 12.0, 4.0])[-1] == -3.0
    assert z([5.0, 5.0, 5.0, 9.0]) == [None] * 4 and z([0.1] * 7) == [None] * 7
    rows = C.rolling(series(spark, [10.0, 20.0, None, 30.0])).orderBy("window_start").collect()
    assert [r.rolling_cpm_avg for r in rows] == [10.0, 15.0, None, 20.0] and not any(r.anomaly for r in rows[:3])
    flags = [r.anomaly for r in C.rolling(series(spark, [10.0, 12.0, 11.0, 40.0, 13.0, 12.5, 60.0, 11.0])).orderBy("window_start").collect()]
    assert flags[6] == (abs(z([10.0, 12.0, 11.0, 40.0, 13.0, 12.5, 60.0, 11.0])[6]) >= 3)


def test_trend_resets(spark):
    def fired(means, n=3, least=0.0):
        return sorted(r.window_start for r in A.rising_trends(series(spark, means), n, least).collect())

    assert len(fired([10.0, 20.0, 30.0])) == 1 and len(fired([10.0, 20.0, 30.0, 40.0])) == 1 and len(fired([10.0, None, 20.0, 30.0])) == 1
    assert len(fired([1.0, 2.0, 3.0, 4.0, 5.0, 6.0])) == 2 and not fired([1.0, 2.0, 3.0], least=5.0) and not fired([3.0, 3.0, 3.0])
    rng = random.Random(6)
    for _ in range(4):
        means, held, want = [float(rng.randrange(6)) for _ in range(40)], [], 0
        for m in means:
            held = [*held, m][-3:]
            if len(held) == 3 and held[0] < held[1] < held[2]:
                want, held = want + 1, []
        assert len(fired(means)) == want


def test_windows_and_alerts(spark):
    t = lambda s: f"2026-06-19 01:{s // 60:02d}:{s % 60:02d}"
    rows = [("a", t(5), 10.0), ("a", t(50), 20.0), ("a", t(70), 300.0), ("a", t(90), 5.0), ("a", t(115), 1500.0)]
    df = spark.createDataFrame([(*r, 35.6895, 139.6917, k) for k, r in enumerate(rows)], "sensor_id string, captured_at string, cpm double, latitude double, longitude double, seq int").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    got = C.cell_windows(Q.with_class(df.orderBy(F.rand(3)))).orderBy("window_start").collect()
    assert [(r["count"], r.cpm_max, tuple(r.class_counts), r.worst_classification, r.geohash) for r in got] == [(2, 20.0, (2, 0, 0), "SAFE", "xn774"), (3, 1500.0, (1, 1, 1), "DANGER", "xn774")]
    hot = spark.createDataFrame([("s", t(60 + 20 * k), 1000.0 + 100 * k, 1.0, 2.0, k) for k in range(3)], "sensor_id string, captured_at string, cpm double, latitude double, longitude double, seq int").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    high = A.sustained_high(Q.with_class(hot))
    assert {(r.cpm, r.breach_count, r.triggered_at) for r in high.collect()} == {(1200.0, 3, t(100))} and high.count() > 1
    assert A.sustained_high(Q.with_class(hot.where("seq < 2"))).count() == 0
    assert A.cooldown(high).count() == 1


def test_cooldown_is_greedy(spark):
    df = spark.createDataFrame([("s", x) for x in (0, 60, 120, 600, 660, 1300, 1899, 1900)], "sensor_id string, x long").withColumn("window_end", F.timestamp_seconds("x"))
    assert sorted(r.x for r in A.cooldown(df).collect()) == [0, 600, 1300, 1900]


def walk(positions, gap):
    out = []
    for x in sorted(set(positions)):
        if not out or x - out[-1] >= gap:
            out.append(x)
    return out


def test_spacing_over_slices(spark):
    """Keys of several densities and lengths, below and above zero, against the plain walk; rows without key or position go."""
    rng = random.Random(1)
    for gap in (0, 1, 3, 60):
        rows = [(None, 1), ("z", None)]
        for k in range(8):
            n = rng.choice([1, 3, 50, 1500])
            span, start = rng.choice([n, 5 * n, 300 * n]), rng.choice([0, -2 * n, 10**9])
            rows += [(f"k{k}", start + rng.randrange(span + 1)) for _ in range(n)]
        got, want = {}, {}
        for r in A.spaced(spark.createDataFrame(rows, "s string, x long"), "s", F.col("x"), gap).distinct().collect():
            got.setdefault(r.s, []).append(r.x)
        for k, x in rows:
            if k is not None and x is not None:
                want.setdefault(k, []).append(x)
        assert {k: sorted(v) for k, v in got.items()} == {k: walk(v, gap) for k, v in want.items()}


def test_spacing_of_a_million_positions(spark):
    """One sensor with a million windows: cut into slices, not walked in one row."""
    df = spark.range(1_000_000).select(F.lit("s").alias("sensor_id"), F.timestamp_seconds(F.col("id") * 60).alias("window_end"))
    began = time.monotonic()
    got = A.cooldown(df).agg(F.count("*").alias("n"), F.sum(F.unix_seconds("window_end")).alias("s")).first()
    assert time.monotonic() - began < 60
    want = walk(range(0, 60_000_000, 60), 600)
    assert (got.n, got.s) == (len(want), sum(want))


def test_region_of_an_alert(spark):
    cells = C.rolling(series(spark, [1.0, 2.0])).withColumn("geohash", F.lit("xn774")).withColumns({"count": F.lit(3).cast("long"), "worst_classification": F.lit("SAFE")})
    at = lambda s: F.timestamp_seconds(F.lit(1_780_000_000 + s))
    base = spark.range(1).select(F.lit("s").alias("sensor_id"), F.lit(35.6895).alias("latitude"), F.lit(139.6917).alias("longitude"))
    alerts = base.withColumn("window_end", at(60)).union(base.withColumn("window_end", at(119))).union(base.withColumn("window_end", at(10))).union(base.withColumn("window_end", at(500)).withColumn("latitude", F.lit(None).cast("double")))
    got = sorted(((r.window_end.timestamp() - 1_780_000_000, r.geohash, r.hot_region and r.hot_region.cpm_avg) for r in A.with_region(alerts, cells).collect()), key=str)
    assert [g[1:] for g in sorted(got)] == [("xn774", None), ("xn774", 1.0), ("xn774", 1.0), (None, None)]


def test_mobility_is_sticky(spark):
    rows = [("s", k, 35.0 + d, 139.0) for k, d in enumerate([0, 0.001, 0.002, 0.0])] + [("f", k, 1.0, 1.0) for k in range(3)]
    got = I.tag_mobility(spark.createDataFrame(rows, "sensor_id string, k int, latitude double, longitude double"), ["k"])
    assert [r.sensor_type for r in got.where("sensor_id = 's'").orderBy("k").collect()] == ["fixed", "fixed", "mobile", "mobile"]
    assert tuple(I.fleet_counts(got).first()) == (2, 1) and tuple(I.fleet_counts(got.limit(0)).first()) == (0, 0)
    with pytest.raises(ValueError):
        I.tag_mobility(got, ["k"], 0)


def test_mobility_in_slices(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", "d", None]), k, rng.choice([None, 35.0]) and 35.0 + rng.randrange(6) / 2000 * (k > 60), 139.0) for k in range(200)]
    rows += [("pole", k, 89.999, lon) for k, lon in enumerate((0.0, 90.0, 180.0))] + [("late", None, 1.0, 1.0), ("late", 3, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "sensor_id string, k int, latitude double, longitude double")
    whole = sorted(map(str, I.tag_mobility(df, ["k"]).collect()))
    assert {r.count("mobile") for r in whole} == {0, 1}
    for width in (1, 7, 50, 1000):
        assert sorted(map(str, I.tag_mobility(df, ["k"], slices=F.floor(F.col("k") / width)).collect())) == whole


LOG = "version long, effective_at timestamp, warn double, danger double, area struct<min_lat: double, max_lat: double, min_lon: double, max_lon: double>, timespan struct<start: timestamp, end: timestamp>"


def test_config_fold(spark):
    rows = [(1, None, 50.0, None, None, None), (2, None, 2000.0, None, None, None), (3, None, None, 500.0, (10.0, 5.0, 0.0, 1.0), None), (4, None, None, 600.0, (30.0, 42.0, 130.0, 145.0), None), (5, None, -1.0, None, None, None)]
    got = G.versions(spark.createDataFrame(rows, LOG)).orderBy("version").collect()
    assert [(r.version, r.warn, r.danger) for r in got] == [(1, 50.0, 1000.0), (4, 50.0, 600.0)] and got[1].area.max_lat == 42.0
    assert tuple(G.current(G.versions(spark.createDataFrame([], LOG))).first())[:2] == (100.0, 1000.0)
    full = '{"cpm_warn_threshold":50,"cpm_danger_threshold":500,"area":%s,"timespan":{}}'
    box = '{"min_lat":30,"max_lat":42,"min_lon":130,"max_lon":145}'
    values = [full % box, full % "{}", full % '{"min_lat":30}', '{"cpm_warn_threshold":50}', "junk"]
    parsed = [r.c for r in spark.createDataFrame([(v,) for v in values], "v string").select(G.parse_message(F.col("v")).alias("c")).collect()]
    assert parsed[0].area.max_lat == 42.0 and parsed[1].area is None and parsed[1].warn == 50.0 and parsed[2:] == [None] * 3


def test_config_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    for row in ((1, None, 50.0, None, None, None), (2, None, None, 500.0, (30.0, 42.0, 130.0, 145.0), None)):
        G.append_update(spark.createDataFrame([row], LOG), path)
    message = G.as_message(G.versions(spark.read.parquet(path)))
    got = message.select(G.parse_message(F.col("value")).alias("c")).first().c
    assert (got.warn, got.danger, got.area.min_lon, got.timespan) == (50.0, 500.0, 130.0, None)


def test_as_of(spark):
    v = G.versions(spark.createDataFrame([(1, None, 50.0, None, None, None), (2, None, None, 60.0, None, None)], LOG).withColumn("effective_at", F.timestamp_seconds(F.col("version") * 100_000)))
    e = spark.createDataFrame([(k, 70.0) for k in (0, 99_999, 100_000, 199_999, 200_000, 900_000)], "k long, cpm double").withColumn("captured_at", F.timestamp_seconds("k"))
    assert [r.classification for r in G.classify_as_of(e, v).orderBy("k").collect()] == ["SAFE", "SAFE", "WARN", "WARN", "DANGER", "DANGER"]
    assert {r.classification for r in G.classify_as_of(e, v.limit(0)).collect()} == {"SAFE"} and G.classify_as_of(e.limit(0), v).count() == 0


def test_long_log_in_pieces(spark):
    rng = random.Random(3)
    pick = lambda *v: rng.choice(v)
    rows = [(k, None, pick(None, None, -5.0, float(rng.randint(1, 900))), pick(None, None, float(rng.randint(1, 900))), pick(None, None, None, (30.0, float(rng.randint(25, 60)), 0.0, 1.0)), None) for k in range(1, 501)]
    now, want = (100.0, 1000.0, None), []
    for k, _, *u, _ in rows:
        w, d, a = (new if new is not None else old for new, old in zip(u, now, strict=True))
        if w > 0 and d > 0 and w < d and (a is None or a[0] < a[1]):
            now = (w, d, a)
            want.append((k, *now))
    log = spark.createDataFrame(rows, LOG).withColumn("effective_at", F.timestamp_seconds(F.col("version") * 40))
    v = G.versions(log)
    assert [(r.version, r.warn, r.danger, r.area and tuple(r.area)) for r in v.orderBy("version").collect()] == want
    e = spark.range(0, 21_000, 7).select("id", F.timestamp_seconds("id").alias("captured_at")).union(spark.sql("select -1L, cast(null as timestamp)"))
    joined = G.as_of(e, v)
    got = {r.id: r.config and r.config.version for r in joined.collect()}
    assert got == {k: max((n for n, *_ in want if 40 * n <= k), default=None) for k in [*range(0, 21_000, 7), -1]}
    assert "Join" not in "".join(line for line in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if ">=" in line)


def fold(rows):
    """Accepted (version, warn, danger) by the plain fold."""
    w, d, out = 100.0, 1000.0, []
    for v, uw, ud in rows:
        new = uw if uw is not None else w, ud if ud is not None else d
        sound = (uw is None or uw > 0) and (ud is None or ud > 0) and (uw is None or ud is None or uw < ud)
        if sound and new[0] < new[1]:
            (w, d), _ = new, out.append((v, *new))
    return out


def folded(spark, rows):
    df = spark.createDataFrame([(v, None, w, d, None, None) for v, w, d in rows], LOG).repartition(3)
    return [(r.version, r.warn, r.danger) for r in G.versions(df).orderBy("version").collect()]


@pytest.mark.parametrize(("n", "whole", "most"), [(700, 0, 6), (2000, 0.002, 60), (1500, 0.05, 3000)])
def test_fold_of_single_thresholds(spark, n, whole, most):
    """Runs of updates with one threshold each over many slices: few values with many ties, and many values."""
    rng = random.Random(n)
    draw = lambda: float(rng.randint(-1, most))
    kinds = rng.choices(["w", "d", "both"], [0.5, 0.5, whole], k=n)
    rows = [(k, draw() if kind != "d" else None, draw() if kind != "w" else None) for k, kind in enumerate(kinds)]
    assert folded(spark, rows) == fold(rows)


def test_fold_of_a_long_run(spark):
    rows = [(k, float(k * 7919 % 900 + 50) if k % 2 == 0 else None, float(k * 104_729 % 1900 + 20) if k % 2 else None) for k in range(100_000)]
    began = time.monotonic()
    assert folded(spark, rows) == fold(rows)
    assert time.monotonic() - began < 90


def test_as_of_spreads_a_hot_slice(spark):
    """All events in one slice of time are dealt to lanes, and read once."""
    v = spark.createDataFrame([(k, float(k), 5000.0) for k in range(1, 51)], "version long, warn double, danger double").select("version", F.timestamp_seconds(F.col("version") * 2).alias("effective_at"), "warn", "danger", F.lit(None).cast(LOG.split("area ")[1].split(", timespan")[0]).alias("area"), F.lit(None).cast("struct<start: timestamp, end: timestamp>").alias("timespan"))
    e = spark.range(0, 40_000, 1, 4).select("id", F.timestamp_seconds(F.col("id") % 120).alias("captured_at"))
    joined = G.as_of(e, v)
    assert {r.id: r.config and r.config.version for r in joined.collect()} == {k: min(k % 120 // 2, 50) or None for k in range(40_000)}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Range (0, 40000") == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = [r.n for r in G.as_of(e, v).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) == 4 and max(per) < 20_000
    far = v.union(v.limit(1).withColumn("effective_at", F.lit("2300-01-01").cast("timestamp")).withColumn("version", F.lit(99).cast("long")))
    late = spark.createDataFrame([(1, "2299-12-31"), (2, "2300-01-01"), (3, "3000-01-01"), (4, "1900-01-01")], "id int, t string").withColumn("captured_at", F.col("t").cast("timestamp"))
    assert {r.id: r.config and r.config.version for r in G.as_of(late, far).collect()} == {1: 50, 2: 99, 3: 99, 4: None}


def test_views(spark):
    with pytest.raises(ValueError):
        V.View.of({"min_lat": 1})
    with pytest.raises(ValueError):
        V.View(start="2024-01-01")
    with pytest.raises(ValueError):
        H.Box(5, 1, 0, 1)
    rows = spark.createDataFrame([(k, f"s{k % 3}", None if k == 4 else 10.0 * k, 1.0) for k in range(10)], "seq long, sensor_id string, latitude double, longitude double")
    view = V.View.of({"min_lat": 15, "max_lat": 35, "min_lon": 0, "max_lon": 2})
    assert sorted(r.seq for r in V.seen(rows, view).collect()) == [2, 3, 4] and V.seen(rows, view, "other").count() == 10
    assert [r.seq for r in V.recent(rows, 3).collect()] == [7, 8, 9] and V.recent(rows, 0).count() == 0
    p = V.page(rows, 8, 3).collect()
    assert [r.seq for r in p] == [5, 6, 7] and all(r.has_more and r.next_cursor == 5 for r in p)
    assert [r.has_more for r in V.page(rows, 3, 5).collect()] == [False] * 3
    assert sorted((r.sensor_id, r.seq) for r in V.latest(rows, ["sensor_id"], ["seq"]).collect()) == [("s0", 9), ("s1", 7), ("s2", 8)]
    d = V.delivery(rows.limit(2), rows, "sensor_id").collect()
    assert [r.lane for r in d] == [0, 0, 1, 1, 1]


def test_views_with_offsets_and_types(spark):
    """Ends of a span are compared as instants, and a request's parts must have their types."""
    view = V.View(start="2024-01-05T00:00:00+09:00", end="2024-01-04T20:00:00Z")
    assert (view.start, view.end) == ("2024-01-04T15:00:00+00:00", "2024-01-04T20:00:00+00:00")
    for start, end in (("2024-01-04T20:00:00Z", "2024-01-05T00:00:00+09:00"), ("2024-01-05", "2024-01-05T00:00:00Z"), ("2024-01-05T09:00:00+09:00", "2024-01-05")):
        with pytest.raises(ValueError):
            V.View(start=start, end=end)
    rows = spark.createDataFrame([(k, f"2024-01-04 {h}:00:00") for k, h in enumerate((14, 15, 18, 20, 21))] + [(9, None), (10, "12:30")], "seq long, captured_at string")
    assert sorted(r.seq for r in V.seen(rows, view).collect()) == [1, 2, 3, 9, 10]
    box = {"min_lat": 1, "max_lat": 2.5, "min_lon": 3, "max_lon": 4}
    assert V.View.of({"type": "subscribe", "area": box, "timespan": {"start": "2024-01-05", "end": "2024-01-06"}}) == V.View(H.Box(1.0, 2.5, 3.0, 4.0), "2024-01-05", "2024-01-06")
    assert V.View.of({"area": None, "timespan": {"start": "", "end": None}}) == V.View() == V.View.of({})
    for bad in ({"area": box | {"min_lat": "1"}}, {"area": box | {"min_lon": True}}, {"area": [1]}, {"timespan": "2024"}, {"timespan": {"start": "2024-01-05", "end": 7}}, {"timespan": {"start": "2024", "end": "2025-01-01"}}, {"timespan": {"start": "2024-01-05"}}, {"min_lat": "1", "max_lat": 2, "min_lon": 3, "max_lon": 4}):
        with pytest.raises(ValueError):
            V.View.of(bad)


def test_insights_of_an_empty_archive(spark):
    empty = spark.createDataFrame([], "geohash string, window_start timestamp, count long, cpm_avg double, cpm_max double, danger_count long, anomaly boolean, centroid_latitude double, centroid_longitude double")
    assert tuple(H.summary(empty).first()) == (0, 0, 0, None, None, None) and H.timeseries(empty).count() == 0 and H.hotspots(empty).count() == 0
    events = spark.createDataFrame([(k, 5) for k in range(4)], "seq long, t long").withColumn("captured_at", F.timestamp_seconds("t"))
    got = {r.bin: r["count"] for r in H.density(events).collect()}
    assert len(got) == 60 and got[0] == 4


def test_insights_by_sql_alone(spark):
    """The views and functions of the catalogue give what the operators give."""
    rows = [(g, d, 10 * k + d, 5.0 * k + d, k == 1, lat) for k, (g, lat) in enumerate((("a", 1.0), ("b", 5.0), ("c", None))) for d in range(1, 6)]
    archive = spark.createDataFrame(rows, "geohash string, d int, count long, cpm_avg double, anomaly boolean, centroid_latitude double").select(
        "geohash", F.make_timestamp(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)).alias("window_start"), F.lit(None).cast("timestamp").alias("window_end"), "count", "cpm_avg", F.col("cpm_avg").alias("cpm_max"), F.col("cpm_avg").alias("cpm_min"),
        *(F.lit(1).cast("long").alias(f"{c}_count") for c in ("safe", "warn", "danger")), F.lit("SAFE").alias("worst_classification"), "centroid_latitude", F.lit(1.0).alias("centroid_longitude"), F.lit(1.0).alias("rolling_cpm_avg"), F.lit(1.0).alias("cpm_zscore"), "anomaly",
    )
    names = catalog.register(spark, archive=archive)
    assert {"archive", "classify", "insight_hotspots"} <= set(names)
    ask = lambda text: sorted(map(tuple, spark.sql(text).collect()), key=str)
    spans = (None, None, None, None), (0.0, 4.0, 0.0, 2.0)
    for box in spans:
        for start, end in ((None, None), ("2024-01-02", "2024-01-04")):
            args = ", ".join("null" if x is None else str(x) for x in box) + ", " + ", ".join("null" if t is None else f"timestamp '{t}'" for t in (start, end))
            part = H.within(archive, H.Box(*box) if box[0] is not None else None, start, end)
            whole = lambda df: sorted(map(tuple, df.collect()), key=str)
            assert ask(f"select * from insight_summary({args})") == whole(H.summary(part))
            assert ask(f"select * from insight_timeseries({args})") == whole(H.trend_points(H.timeseries(part)))
            assert ask(f"select * from insight_hotspots({args}, 2)") == whole(H.hotspots(part, 2).drop("share"))
            assert ask(f"select geohash, window_start from archive_within({args})") == whole(part.select("geohash", "window_start"))
    levels = ask("select classify(x), classify(x, 1, 2), severity(classify(x)), plausible(x) from values (cast(null as double)), (5), (500), (5000), (-1), (double('nan')) v(x)")
    d = lambda x: F.lit(x).cast("double")
    want = [one(spark, X.classify(d(x)), X.classify(d(x), 1.0, 2.0), X.severity(X.classify(d(x))), X.plausible(d(x))) for x in (None, 5.0, 500.0, 5000.0, -1.0, float("nan"))]
    assert levels == sorted(want, key=str)
    assert abs(ask("select distance_m(0, 0, 0, 1)")[0][0] - 6_371_000 * math.pi / 180) < 1e-6
    plan = spark.sql("select * from archive_within(null, null, null, null, timestamp '2024-01-02', null)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan


def test_csv_and_archive(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Captured Time, Device ID ,Latitude,Loader ID,junk,Uploaded Time\nt1,d1,1.0,,x,b\nt2,d2,,7,x,\nt3,d3,2,8,x,a\n")
    rows = S.read_csv(spark, str(tmp_path / "in.csv"))
    assert rows.columns == ["captured_at", "device_id", "latitude", "measurement_import_id", "uploaded_at"] and rows.collect()[1].latitude == ""
    assert [r.device_id for r in S.in_upload_order(rows, True).collect()] == ["d3", "d1", "d2"]
    assert [r.device_id for r in S.read_csv(spark, str(tmp_path / "in.csv"), 1).collect()] == ["d2", "d3"]
    cells = spark.createDataFrame([("g", 1, 5), ("h", 1, 6), (None, 1, 7)], "geohash string, t long, count long").withColumn("window_start", F.timestamp_seconds("t")).withColumn("class_counts", F.struct(F.lit(1).cast("long").alias("SAFE"), F.lit(None).cast("long").alias("WARN"), F.lit(0).cast("long").alias("DANGER"))).drop("t")
    path = str(tmp_path / "archive")
    S.append_batch(S.archive_rows(cells), path, 0)
    for _ in range(2):  # a replay overwrites
        S.append_batch(S.archive_rows(cells.where("geohash = 'g'").withColumn("count", F.lit(9).cast("long"))), path, 1)
    assert sorted((r.geohash, r["count"], r.warn_count) for r in S.read_archive(spark, path).collect()) == [("g", 9, 0), ("h", 6, 0)]
    S.compact(spark, path, str(tmp_path / "compacted"))
    assert S.read_archive(spark, str(tmp_path / "compacted")).count() == 2


def test_messages(spark):
    df = spark.createDataFrame([("s", None, None), ("t", 1.0, "cpm")], "sensor_id string, cpm double, unit string")
    assert [r.value for r in S.keyed(df).collect()] == ['{"sensor_id":"s","cpm":null}', '{"sensor_id":"t","cpm":1.0,"unit":"cpm"}']
    assert S.security_options({}) == {} and S.security_options({"KAFKA_SECURITY_PROTOCOL": "SSL"}) == {"kafka.security.protocol": "SSL"}
    sasl = S.security_options({"KAFKA_SECURITY_PROTOCOL": "SASL_SSL", "KAFKA_SASL_MECHANISM": "SCRAM-SHA-256", "KAFKA_SASL_USERNAME": "u", "KAFKA_SASL_PASSWORD": 'a"\\b'})
    assert sasl["kafka.sasl.jaas.config"].endswith('scram.ScramLoginModule required username="u" password="a\\"\\\\b";')
    assert S.publish_options("h:1", "t")["kafka.acks"] == "all" and S.topic_options("h:1", ["a", "b"])["subscribe"] == "a,b"
    got = S.envelope(spark.createDataFrame([("radiation.clean", '{"a":1}'), ("radiation.alerts", "junk"), ("x.other", "{}"), ("radiation.aggregated", "[1]")], "topic string, value string")).collect()
    assert [(r.type, r.data) for r in got] == [("clean", '{"a":1}')]
