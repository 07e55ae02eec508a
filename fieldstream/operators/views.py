"""What a viewer sees: filters, pages, latest rows and delivery order."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.functions import expr as X
from fieldstream.operators.insights import Box

PAGE, MOST_PAGE, RECENT, LOG, MOST_ALERTS, MOST_KEYS = 50, 500, 500, 50, 100, 5000
# Where each type of message has its position and time.
FIELDS = {
    "clean": (("latitude", "longitude"), ("captured_at",)),
    "aggregated": (("centroid_latitude", "centroid_longitude"), ("window_start",)),
    "alert": (("latitude", "longitude"), ("window_start", "triggered_at")),
}


def instant(text: str) -> datetime:
    """An ISO-8601 text as ``X.timestamp`` reads it: an instant, UTC where it has no offset."""
    text = text.strip(X.WHITE)
    if not re.match(X.TIME, text):
        raise ValueError(f"no ISO-8601 time: {text!r}")
    when = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text))
    return when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)


@dataclass(frozen=True)
class View:
    """A box and a span, either of which may be absent; both ends count.  A span is kept as UTC text."""

    box: Box | None = None
    start: str | None = None
    end: str | None = None

    def __post_init__(self):
        if (self.start is None) != (self.end is None):
            raise ValueError("a span needs both ends")
        if self.start is not None:
            start, end = instant(self.start), instant(self.end)
            if not start < end:
                raise ValueError("a span must end after it starts")
            object.__setattr__(self, "start", start.isoformat())
            object.__setattr__(self, "end", end.isoformat())

    @classmethod
    def of(cls, request: Mapping) -> View:
        """From a request: sides and ends in it, or in its objects ``area`` and ``timespan``.

        A box has all four sides or none, which must be numbers; ends are ISO-8601 texts, and a blank one is none.
        """
        area, span = (request.get(k) or {} if "area" in request or "timespan" in request else request for k in ("area", "timespan"))
        if not isinstance(area, Mapping) or not isinstance(span, Mapping):
            raise ValueError("area and timespan must be objects")
        sides = [area.get(k) for k in ("min_lat", "max_lat", "min_lon", "max_lon")]
        if any(s is not None for s in sides) and any(s is None for s in sides):
            raise ValueError("a box needs all four sides")
        if any(isinstance(s, bool) or not isinstance(s, int | float) for s in sides if s is not None):
            raise ValueError("the sides of a box must be numbers")
        ends = [span.get(k) or None for k in ("start", "end")]
        if any(e is not None and not isinstance(e, str) for e in ends):
            raise ValueError("the ends of a span must be texts")
        return cls(None if sides[0] is None else Box(*map(float, sides)), *ends)

    def matches(self, kind: str, columns: list[str]) -> Column:
        """Whether a message of this kind is seen; one without the fields is, and so is an unknown kind."""
        if kind not in FIELDS:
            return F.lit(True)
        (lat, lon), times = FIELDS[kind]
        place = (F.col(lat), F.col(lon)) if lat in columns and lon in columns else None
        return self.holds(place, [F.col(t) for t in times if t in columns])

    def holds(self, place: tuple[Column, Column] | None, times: list[Column]) -> Column:
        """Whether a place and the first of some times that can be read are in the view; what is missing is."""
        ok = F.lit(True)
        if self.box and place:
            ok = ok & F.coalesce(self.box.holds(*place), F.lit(True))
        have = [X.timestamp(t.cast("string")) for t in times]
        if self.start and have:
            at = F.coalesce(*have)
            ok = ok & F.coalesce(at.between(F.lit(self.start).cast("timestamp"), F.lit(self.end).cast("timestamp")), F.lit(True))
        return ok


def seen(rows: DataFrame, view: View, kind: str = "clean") -> DataFrame:
    return rows.where(view.matches(kind, rows.columns))


def recolour(events: DataFrame, warn: float | None, danger: float | None) -> DataFrame:
    """Adds shown_class: by the viewer's thresholds if they are valid, else the class that the event has."""
    valid = warn is not None and danger is not None and 0 < warn < danger
    shown = F.coalesce(X.classify(F.col("cpm"), warn, danger), F.col("classification")) if valid else F.col("classification")
    return events.withColumn("shown_class", shown)


def recent(rows: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The newest n rows, the oldest first."""
    return rows.orderBy(F.desc(order)).limit(max(0, n)).orderBy(order)


def page(rows: DataFrame, cursor: int | Column | None = None, limit: int = PAGE, window: int = RECENT, order: str = "seq") -> DataFrame:
    """Of the newest ``window`` rows, the newest ``limit`` before the cursor, the oldest first, with has_more and next_cursor on each row.

    The cursor may be a column of the rows; where it is null, there are none.
    """
    limit = min(max(limit, 1), MOST_PAGE)
    held = rows.orderBy(F.desc(order)).limit(window)
    if cursor is not None:
        held = held.where(F.col(order) < cursor)
    more = held.orderBy(F.desc(order)).limit(limit + 1).withColumn("__n", F.row_number().over(Window.orderBy(F.desc(order))))  # at most limit + 1 rows
    all_rows = Window.partitionBy(F.lit(0)).orderBy("__n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = more.withColumn("has_more", F.max("__n").over(all_rows) > limit).where(F.col("__n") <= limit)
    return whole.withColumn("next_cursor", F.min(order).over(all_rows)).drop("__n").orderBy(order)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def newest_of_key(rows: DataFrame, keys: list[str], order: str = "seq", most: int = 100) -> DataFrame:
    """Rows replaced by key, the newest ``most`` of them."""
    return latest(rows, keys, [order]).orderBy(F.desc(order)).limit(most)


def alert_log(alerts: DataFrame, n: int = LOG) -> DataFrame:
    """The newest alerts, the newest first; ties by sensor and reason."""
    return alerts.orderBy(F.desc("window_end"), "sensor_id", "reason", F.desc("window_start")).limit(n)


def delivery(alerts: DataFrame, state: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Alerts first, in order, the newest 100; then the latest row of each key, the 5000 that changed last."""
    first = alerts.orderBy(F.desc(order)).limit(MOST_ALERTS).withColumn("lane", F.lit(0))
    rest = latest(state, [key], [order]).orderBy(F.desc(order)).limit(MOST_KEYS).withColumn("lane", F.lit(1))
    return first.unionByName(rest, allowMissingColumns=True).orderBy("lane", order)
