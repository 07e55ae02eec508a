"""Configuration as data: a log of partial updates, folded into versions, and joined to events by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from fieldstream.functions import expr as X
from fieldstream.schemas import AREA, CONFIG, SPAN
from fieldstream.sources.scratch import kept, ranked

#: Seconds of a slice of events at least, slices that the versions of a log span at most, and lanes that the events of a slice are dealt to.
SLICE_S, MOST_SLICES, LANES = 600, 100_000, 16
#: Updates in a slice of a log.
LOG_SLICE = 128
COLUMNS = ["version", "effective_at", "warn", "danger", "area", "timespan"]


def fault(u: Column) -> Column:
    """Why a configuration (a struct) is invalid, or null."""
    a, t = u["area"], u["timespan"]
    bad_box = ~F.coalesce(
        a["min_lat"].between(-90.0, 90.0) & a["max_lat"].between(-90.0, 90.0) & a["min_lon"].between(-180.0, 180.0) & a["max_lon"].between(-180.0, 180.0) & (a["min_lat"] < a["max_lat"]) & (a["min_lon"] < a["max_lon"]),
        F.lit(False),
    )
    return (
        F.when((u["warn"] <= 0) | (u["danger"] <= 0), "threshold not positive").when(u["warn"] >= u["danger"], "warn not below danger")
        .when(a.isNotNull() & bad_box, "bad area").when(t.isNotNull() & ~F.coalesce(t["start"] < t["end"], F.lit(False)), "bad timespan")
    )


def parse_message(value: Column) -> Column:
    """A configuration message as a struct, null if malformed: both thresholds are required, an empty area or timespan means none, an area has all its four keys or is malformed."""
    c = F.from_json(value, CONFIG)
    empty = lambda name: F.coalesce(F.get_json_object(value, f"$.{name}"), F.lit("{}")).isin("{}", "null")
    whole_area = c["area"]["min_lat"].isNotNull() & c["area"]["max_lat"].isNotNull() & c["area"]["min_lon"].isNotNull() & c["area"]["max_lon"].isNotNull()
    ok = c["cpm_warn_threshold"].isNotNull() & c["cpm_danger_threshold"].isNotNull() & (empty("area") | F.coalesce(whole_area, F.lit(False)))
    return F.when(
        ok,
        F.struct(
            c["cpm_warn_threshold"].alias("warn"), c["cpm_danger_threshold"].alias("danger"),
            F.when(~empty("area"), c["area"]).alias("area"), F.when(~empty("timespan"), c["timespan"]).alias("timespan"),
        ),
    )


def as_message(all_versions: DataFrame) -> DataFrame:
    """One row with ``value``: the merged configuration in force as the JSON message that is published; what is absent is left out."""
    c = current(all_versions)
    return c.select(F.to_json(F.struct(F.col("warn").alias("cpm_warn_threshold"), F.col("danger").alias("cpm_danger_threshold"), "area", "timespan")).alias("value"))


def append_update(update: DataFrame, path: str) -> None:
    """Add updates (the columns of a log) to the log's table."""
    update.select("version", "effective_at", "warn", "danger", "area", "timespan").write.mode("append").parquet(path)


def _carried(rows: DataFrame, names: list[str], part: list[str], order: list[str]) -> DataFrame:
    """Adds ``__last_<name>``: the last value of each name that is not null, up to each row in ``order``.

    ``part`` are columns that ``order`` never takes back: the first is the slice, which carries on from the slices before it; the rest tell
    rows of a slice apart that need nothing.  Only one row for each slice meets in one task.
    """
    so_far = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(*order)
    ends = rows.groupBy(part[0]).agg(*(F.max_by(F.when(F.col(n).isNotNull(), F.col(n)), F.when(F.col(n).isNotNull(), key)).alias(f"__end_{n}") for n in names))
    before = Window.orderBy(part[0]).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.where(F.col(part[0]).isNotNull()).select(part[0], *(F.last(f"__end_{n}", ignorenulls=True).over(before).alias(f"__in_{n}") for n in names))
    inside = rows.select("*", *(F.last(n, ignorenulls=True).over(so_far).alias(f"__own_{n}") for n in names))
    joined = inside.join(ends, part[0], "left")
    return joined.select(*rows.columns, *(F.coalesce(f"__own_{n}", f"__in_{n}").alias(f"__last_{n}") for n in names))


STATE = "struct<warn: double, danger: double>"
NONE = 1 << 62  # a rank after all others


def _state(warn: Column, danger: Column) -> Column:
    return F.struct(warn.alias("warn"), danger.alias("danger"))


def _piece(updates: Column, warn: Column, danger: Column, fixed: str) -> Column:
    """What sound updates make of a state: ``t``, the rank of the first accepted one, and the thresholds after the last; ``fixed`` is null while no update replaces it."""
    start = F.struct(_state(warn, danger).alias("now"), F.lit(None).cast("long").alias("t"), F.lit(False).alias("replaced"))

    def step(acc: Column, u: Column) -> Column:
        new = _state(*(F.coalesce(u[n], acc["now"][n]) for n in ("warn", "danger")))
        after = F.struct(new.alias("now"), F.coalesce(acc["t"], u["rank"]).alias("t"), (acc["replaced"] | u[fixed].isNotNull()).alias("replaced"))
        return F.when(new["warn"] < new["danger"], after).otherwise(acc)

    def end(acc: Column) -> Column:
        value = lambda n: (F.when(acc["replaced"], acc["now"][n]) if n == fixed else acc["now"][n]).alias(n)
        return F.struct(acc["t"].alias("t"), value("warn"), value("danger"))

    return F.aggregate(updates, start, step, end)


def _pieces(updates: Column) -> tuple[Column, Column]:
    """A slice of the log as a map of the state before it: pieces by the danger threshold, and pieces by the warn threshold.

    Until one is replaced, an update is judged by the other threshold alone: a new warn by the danger that came in, a new danger by the
    warn that came in.  What happens once the first is accepted depends on the one that still stands.  So there is one piece
    for each interval between the values that it is compared with; neighbours alike are merged.
    """
    values = lambda n: F.array_sort(F.array_distinct(F.filter(F.transform(updates, lambda u: u[n]), lambda v: v.isNotNull())))
    infinite = F.lit(float("inf"))
    by_danger = F.transform(F.concat(values("warn"), F.array(infinite)), lambda b: F.struct(b.alias("bound"), _piece(updates, infinite, b, "danger").alias("then")))
    by_warn = F.transform(F.concat(F.array(-infinite), values("danger")), lambda a: F.struct(a.alias("bound"), _piece(updates, a, -infinite, "warn").alias("then")))
    return by_danger, by_warn


def _merged(pieces: Column, step: int) -> Column:
    """Of neighbours with one outcome, the one whose bound holds for all."""
    return F.filter(pieces, lambda p, i: ~F.coalesce(p["then"].eqNullSafe(F.get(pieces, i + step)["then"]) & F.get(pieces, i + step).isNotNull(), F.lit(False)))


def _after(now: Column, by_danger: Column, by_warn: Column) -> Column:
    """The state after a slice."""
    d = F.coalesce(F.get(F.filter(by_danger, lambda p: now["danger"] <= p["bound"]), F.lit(0)), F.element_at(by_danger, -1))["then"]
    w = F.element_at(F.filter(by_warn, lambda p: p["bound"] <= now["warn"]), -1)["then"]
    td, tw = F.coalesce(d["t"], F.lit(NONE)), F.coalesce(w["t"], F.lit(NONE))
    first_warn, first_danger = _state(d["warn"], F.coalesce(d["danger"], now["danger"])), _state(F.coalesce(w["warn"], now["warn"]), w["danger"])
    return F.when((td <= tw) & (td < NONE), first_warn).when(tw < NONE, first_danger).otherwise(now)


def versions(log: DataFrame) -> DataFrame:
    """Folds a log (version, effective_at, warn, danger, area, timespan; nulls keep what is current) in order.

    One row per accepted update: version, effective_at and the merged state.  An update whose
    merged state is invalid changes nothing.  The log is cut into slices of 128 updates, and each becomes a map of the thresholds
    that come in.  A slice with an update of both thresholds leaves a state of its own, so maps are composed only from
    one such slice to the next, and each slice is then folded from the state it begins with.  Only one row for each slice,
    with its merged map, ever meets in one task.  Areas and timespans are carried over the accepted updates.
    """
    sound = log.select(*COLUMNS).where(fault(F.struct("warn", "danger", "area", "timespan")).isNull())
    update = F.struct(F.col("__rank").alias("rank"), *COLUMNS)
    ordered = ranked(sound, COLUMNS, "config-log").withColumn("__slice", F.expr(f"cast(__rank div {LOG_SLICE} as int)"))
    # few bytes and much work: without a number the small partitions would become one
    slices = ordered.repartition(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__slice").groupBy("__slice").agg(F.sort_array(F.collect_list(update)).alias("updates"))
    by_danger, by_warn = _pieces(F.col("updates"))
    both = F.exists("updates", lambda u: u["warn"].isNotNull() & u["danger"].isNotNull())
    raw = slices.select("__slice", both.alias("both"), by_danger.alias("d"), by_warn.alias("w"))
    maps = kept(raw.select("__slice", "both", _merged(F.col("d"), 1).alias("d"), _merged(F.col("w"), -1).alias("w")), "config-maps")
    default = _state(F.lit(X.WARN), F.lit(X.DANGER))
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("both"), _after(default, F.col("d"), F.col("w"))).cast(STATE)
    begun = maps.select("__slice", own.alias("own"), F.col("both").cast("int").alias("n")).select(F.col("__slice"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("run"), F.coalesce(F.last("own", ignorenulls=True).over(earlier), default.cast(STATE)).alias("start"))
    runs = maps.join(begun, "__slice").groupBy("run").agg(F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("__slice", "d", "w"))).alias("parts"))
    none = F.struct(F.col("start").alias("now"), F.expr(f"cast(array() as array<struct<__slice: int, start: {STATE}>>)").alias("out"))
    step = lambda acc, p: F.struct(_after(acc["now"], p["d"], p["w"]).cast(STATE).alias("now"), F.concat(acc["out"], F.array(F.struct(p["__slice"].alias("__slice"), acc["now"].alias("start")))).alias("out"))
    starts = runs.select(F.explode(F.aggregate("parts", none, step, lambda acc: acc["out"])).alias("s")).select("s.*")
    out_type = f"struct<version: bigint, effective_at: timestamp, warn: double, danger: double, area: {AREA.simpleString()}, timespan: {SPAN.simpleString()}>"

    def merge(acc: Column, u: Column) -> Column:
        new = _state(*(F.coalesce(u[n], acc["now"][n]) for n in ("warn", "danger")))
        row = F.struct(u["version"].cast("long").alias("version"), u["effective_at"].alias("effective_at"), new["warn"].alias("warn"), new["danger"].alias("danger"), u["area"].alias("area"), u["timespan"].alias("timespan")).cast(out_type)
        return F.when(new["warn"] < new["danger"], F.struct(new.cast(STATE).alias("now"), F.concat(acc["out"], F.array(row)).alias("out"))).otherwise(acc)

    folded = F.aggregate("updates", F.struct(F.col("start").alias("now"), F.expr(f"cast(array() as array<{out_type}>)").alias("out")), merge, lambda acc: acc["out"])
    accepted = kept(slices.join(starts, "__slice").select("__slice", F.explode(folded).alias("v")).select("__slice", "v.*"), "config-versions")
    whole = _carried(accepted, ["area", "timespan"], ["__slice"], COLUMNS)
    return whole.select("version", "effective_at", "warn", "danger", F.col("__last_area").alias("area"), F.col("__last_timespan").alias("timespan"))


def current(all_versions: DataFrame) -> DataFrame:
    """The latest version, or the defaults where there is none: always one row."""
    newest = all_versions.agg(F.max_by(F.struct("warn", "danger", "area", "timespan"), "version").alias("v"))
    return newest.select(F.coalesce("v.warn", F.lit(X.WARN)).alias("warn"), F.coalesce("v.danger", F.lit(X.DANGER)).alias("danger"), "v.area", "v.timespan")


def as_of(events: DataFrame, all_versions: DataFrame, time: str = "captured_at") -> DataFrame:
    """Adds ``config``: the version in force at each event's time, null before the first; of versions with equal times the later one holds.

    One ordered pass over versions and events without a join: they are cut into slices of time, the versions of a
    slice, and the one it begins with, go to each of 16 lanes, and its events are dealt to the lanes, so a slice with all events is spread.  Events are read once.
    Slices are ten minutes long, or longer where the log spans more than 100,000 of these.
    """
    config = F.struct("version", "warn", "danger", "area", "timespan")
    timed = all_versions.where("effective_at is not null").select(F.col("effective_at").alias("__t"), F.lit(0).alias("__kind"), F.col("version").alias("__v"), config.alias("__config"))
    ends = timed.agg(F.min(F.unix_seconds("__t")).alias("low"), F.max(F.unix_seconds("__t")).alias("high")).first()
    low, high = (ends.low, ends.high) if ends.low is not None else (0, 0)
    width = max(SLICE_S, -(-(high - low) // MOST_SLICES))
    place = lambda t: F.floor((F.unix_seconds(t) - low) / width)
    last = (high - low) // width
    timed = timed.withColumn("__slice", place("__t"))
    ordered = Window.orderBy("__slice")  # one row for each slice
    newest = timed.groupBy("__slice").agg(F.max_by("__config", F.struct("__t", "__v")).alias("__config")).withColumn("__next", F.coalesce(F.lead("__slice").over(ordered), F.lit(last + 1)))
    carried = newest.select(F.explode(F.sequence(F.col("__slice") + 1, "__next")).alias("__slice"), "__config").select(
        F.timestamp_seconds(F.col("__slice") * width + low).alias("__t"), F.lit(-1).alias("__kind"), F.lit(None).cast("long").alias("__v"), "__config", "__slice",
    )
    side = timed.unionByName(carried).withColumn("__lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))).withColumn("__event", F.lit(None).cast(events.schema))
    plain = [f"`{f.name}`" for f in events.schema.fields if not isinstance(f.dataType, MapType | ArrayType | StructType | VariantType)]
    at = F.col(time).cast("timestamp")
    main = events.select(
        at.alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__v"), F.lit(None).cast(timed.schema["__config"].dataType).alias("__config"), F.least(place(at), F.lit(last + 1)).alias("__slice"),
        F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.lit(LANES)).cast("int").alias("__lane"), F.struct(*(F.col(f"`{c}`") for c in events.columns)).alias("__event"),
    )
    so_far = Window.partitionBy("__slice", "__lane").orderBy("__t", "__kind", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = side.unionByName(main).withColumn("__last", F.last("__config", ignorenulls=True).over(so_far)).where("__kind = 1")
    return seen.select("__event.*", F.col("__last").alias("config"))


def classify_as_of(events: DataFrame, all_versions: DataFrame) -> DataFrame:
    """Events with the class that the thresholds in force give them."""
    joined = as_of(events, all_versions)
    return joined.withColumn("classification", X.classify(F.col("cpm"), F.coalesce("config.warn", F.lit(X.WARN)), F.coalesce("config.danger", F.lit(X.DANGER))))


def in_region(config: Column, lat: Column, lon: Column, ts: Column) -> Column:
    """Whether the area and timespan of a configuration let an event pass; what is absent lets all pass."""
    return config.isNull() | (X.in_area(lat, lon, config["area"]) & X.in_timespan(ts, config["timespan"]))
