"""Validation, filters, deduplication and classification of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.functions import expr as X
from fieldstream.schemas import RAW_EVENT

REQUIRED = ("sensor_id", "captured_at", "uploaded_at", "latitude", "longitude")


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to the fields of a raw event; malformed text gives nulls."""
    return messages.select("*", F.from_json(F.col(value), RAW_EVENT, {"mode": "PERMISSIVE"}).alias("event"))


# JSON types of the fields of an event, with those that may be null explicitly, and the lists and patterns of some.
TEXTS = {"sensor_id": False, "captured_at": False, "uploaded_at": False, "unit": False, "classification": True, "sensor_type": True, "location_name": True, "surface": True, "md5sum": True, "loader_id": True}
NUMBERS = {"latitude": False, "longitude": False, "cpm": True, "height": True}
MOBILITY = ("mobile", "fixed")
MD5 = "^[a-f0-9]{32}$"


def breaks_contract(raw: Column) -> Column:
    """Whether a JSON object has an unknown property, a field of the wrong JSON type, or a value that its list or pattern doesn't have; false for what is no object."""
    known = F.array(*(F.lit(n) for n in (*TEXTS, *NUMBERS)))
    parsed = F.try_parse_json(raw)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    bad = F.coalesce(F.size(F.array_except(F.json_object_keys(raw), known)) > 0, F.lit(False))
    for fields, types in ((TEXTS, "STRING"), (NUMBERS, "BIGINT|DOUBLE|FLOAT|DECIMAL.*")):
        for name, nullable in fields.items():
            bad = bad | F.coalesce(~kind(name).rlike(f"^(?:{types}{'|VOID' if nullable else ''})$"), F.lit(False))
    text = lambda name: F.get_json_object(raw, f"$.{name}")
    return bad | F.coalesce(~text("classification").isin(*X.LEVELS) | ~text("sensor_type").isin(*MOBILITY), F.lit(False)) | F.coalesce(~text("md5sum").rlike(MD5), F.lit(False))


def discard_reason(e: Column, raw: Column | None = None) -> Column:
    """Why the contract rejects an event (a struct of texts), the first reason that holds; null if it is valid.

    With the message's text (``raw``), JSON types, unknown properties and the other fields are checked as well.
    """
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | F.coalesce(e[name].cast("string"), F.lit("")).eqNullSafe("")
    text = e["cpm"].cast("string")
    cpm = X.number(text)
    no_object = e.isNull() if raw is None else (e.isNull() | ~F.coalesce(F.trim(raw), F.lit("")).startswith("{"))
    lat, lon = X.number(e["latitude"].cast("string")), X.number(e["longitude"].cast("string"))
    odd = ~X.valid_position(lat, lon) | X.timestamp(e["captured_at"].cast("string")).isNull() | (e["unit"].isNotNull() & ~e["unit"].isin(*X.UNITS))
    if raw is not None:
        odd = odd | breaks_contract(raw)
    return (
        F.when(no_object, "not an object").when(missing, "missing field").when(text.isNotNull() & cpm.isNull(), "cpm not numeric")
        .when(~X.plausible(text), "cpm out of range").when(odd, "schema violation")
    )


def split_valid(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid messages with ``event``, quarantine with ``discard_reason``)."""
    judged = decode(messages, value).withColumn("discard_reason", discard_reason(F.col("event"), F.col(value)))
    return judged.where("discard_reason is null").drop("discard_reason"), judged.where("discard_reason is not null").drop("event")


def parse(messages: DataFrame, value: str = "value") -> DataFrame:
    """Typed events; rows without required fields, a numeric position or a readable time are dropped.  Neither an empty sensor nor the range of a position is checked here."""
    e = F.col("event")
    typed = decode(messages, value).select(
        *(e[n].alias(n) for n in ("sensor_id", "unit", "classification", "sensor_type", "location_name", "surface", "loader_id", "md5sum")),
        X.timestamp(e["captured_at"]).alias("captured_at"), X.timestamp(e["uploaded_at"]).alias("uploaded_at"), *(X.number(e[n]).alias(n) for n in ("latitude", "longitude", "cpm", "height")),
    )
    return typed.dropna(subset=list(REQUIRED))


def with_value(events: DataFrame) -> DataFrame:
    """Readings that have a count."""
    return events.where("cpm is not null")


def plausible(events: DataFrame) -> DataFrame:
    """Readings whose count is between 0 and a million; a null passes."""
    return events.where(X.plausible(F.col("cpm")))


def first_of_repeats(events: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each sensor and checksum (or time)."""
    key = X.dedup_key(F.col("md5sum"), F.col("captured_at"))
    return events.withColumn("__n", F.row_number().over(Window.partitionBy("sensor_id", key).orderBy(*order))).where("__n = 1").drop("__n")


def with_class(events: DataFrame, warn: float = X.WARN, danger: float = X.DANGER) -> DataFrame:
    return events.withColumn("classification", X.classify(F.col("cpm"), warn, danger))
