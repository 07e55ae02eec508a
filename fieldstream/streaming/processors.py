"""Per-key state of the streaming jobs.

Each processor takes the rows of one key, sorts what came in one batch by event
time, and keeps a bounded state: a few numbers, or the last windows of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, cos, floor, radians, sin, sqrt

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def round4(x: float) -> float:
    return floor(x * 10_000 + 0.5) / 10_000


class FirstOfRepeats(StatefulProcessor):
    """The first row of each checksum of a sensor; a checksum is forgotten ``ttl_ms`` of wall-clock time after it was first met."""

    def __init__(self, columns: list[str], order: str, ttl_ms: int = 3_600_000):
        self.columns, self.order, self.ttl_ms = columns, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "k string", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r[self.order]):
            if not self.seen.containsKey((r["dedup_key"],)):
                self.seen.updateValue((r["dedup_key"],), (1,))
                yield Row(**{c: r[c] for c in self.columns})

    def close(self) -> None:
        pass


class Rolling(StatefulProcessor):
    """Adds rolling_cpm_avg, cpm_zscore and anomaly to the windows of a cell; windows without a mean pass with nulls."""

    def __init__(self, columns: list[str], back: int = 6, anomaly: float = 3.0, ttl_ms: int = 3_600_000):
        self.columns, self.back, self.anomaly, self.ttl_ms = columns, back, anomaly, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "means array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get()
        means = list(held[0]) if held else []
        for r in sorted(rows, key=lambda r: r["window_start"]):
            mean, rolling, z = r["cpm_avg"], None, None
            if mean is not None:
                whole = [round(m * 10_000) for m in [*means, mean]]
                rolling = round4(sum(whole) / len(whole) / 10_000)
                n, s, q = len(means), sum(whole[:-1]), sum(x * x for x in whole[:-1])
                if n >= 2 and n * q > s * s:
                    z = round4((n * whole[-1] - s) / sqrt(n * q - s * s))
                means = [*means, mean][-self.back :]
            yield Row(**{c: r[c] for c in self.columns}, rolling_cpm_avg=rolling, cpm_zscore=z, anomaly=z is not None and abs(z) >= self.anomaly)
        self.last.update((means,))

    def close(self) -> None:
        pass


class RisingTrend(StatefulProcessor):
    """One row (means, and the window that completed them) for each strict rise of N means by ``least`` in all; then the series starts anew."""

    def __init__(self, windows: int = 3, least: float = 5.0, ttl_ms: int = 3_600_000):
        self.windows, self.least, self.ttl_ms = max(2, windows), least, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState("series", "means array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.series.get()
        means = list(held[0]) if held else []
        for r in sorted(rows, key=lambda r: r["window_start"]):
            if r["cpm_avg"] is None:
                continue
            means = [*means, r["cpm_avg"]][-self.windows :]
            if len(means) == self.windows and all(a < b for a, b in zip(means, means[1:], strict=False)) and means[-1] - means[0] >= self.least:
                yield Row(geohash=key[0], window_start=r["window_start"], window_end=r["window_end"], cpm=r["cpm_max"], cpm_series=means, delta=round4(means[-1] - means[0]))
                means = []
        self.series.update((means,))

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Alerts of a sensor whose window ends at least ``seconds`` after the last one that was let through."""

    def __init__(self, columns: list[str], seconds: int = 600):
        self.columns, self.seconds = columns, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ended double", max(10 * self.seconds, 3600) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get()
        last = held[0] if held else None
        for r in sorted(rows, key=lambda r: r["window_end"]):
            ended = r["window_end"].timestamp()
            if last is None or ended - last >= self.seconds:
                last = ended
                yield Row(**{c: r[c] for c in self.columns})
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


class NewestCell(StatefulProcessor):
    """Joins alerts to the newest cell of their geohash; rows come tagged, with ``cell`` or ``alert`` as JSON."""

    def __init__(self, ttl_ms: int = 3_600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState("cell", "json string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.cell.get()
        cell = held[0] if held else None
        for r in sorted(rows, key=lambda r: (r["window_end"], r["alert"] is not None)):
            if r["alert"] is None:
                cell = r["cell"]
            else:
                yield Row(geohash=key[0], alert=r["alert"], hot_region=cell)
        if cell is not None:
            self.cell.update((cell,))

    def close(self) -> None:
        pass


class Timed(StatefulProcessor):
    """State by event time: a key is forgotten once the watermark is ``keep_ms`` past its newest row.  One timer for each key."""

    keep_ms: int

    def renew(self, newest_ms: int) -> None:
        """Forget the key ``keep_ms`` after this time instead of the time set before."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(newest_ms + self.keep_ms)

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


def millis(t) -> int:
    return round(t.timestamp() * 1000)


class CooldownByTime(Timed):
    """Alerts of a sensor whose window ends at least ``seconds`` after the last one that was let through; a forgotten sensor's next alert is far enough."""

    def __init__(self, columns: list[str], seconds: int = 600):
        self.columns, self.seconds, self.keep_ms = columns, seconds, max(10 * seconds, 3600) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ended long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get()
        last = held[0] if held else None
        for r in sorted(rows, key=lambda r: r["window_end"]):
            ended = millis(r["window_end"])
            if last is None or ended - last >= self.seconds * 1000:
                last = ended
                yield Row(**{c: r[c] for c in self.columns})
        if last is not None:
            self.last.update((last,))
            self.renew(last)

    def forget(self) -> None:
        self.last.clear()


#: Fields of a cell that an alert carries.
REGION = {"cpm_avg": "double", "cpm_max": "double", "count": "long", "worst_classification": "string", "centroid_latitude": "double", "centroid_longitude": "double"}


class RegionByTime(Timed):
    """Joins alerts to the newest cell of their geohash.  Rows have ``cell`` (a struct, null for an alert) and the fields of an alert; out go the fields and hot_region."""

    def __init__(self, columns: list[str], keep_s: int = 3600):
        self.columns, self.keep_ms = columns, keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("cell", ", ".join(f"{n} {kind}" for n, kind in REGION.items()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.cell.get()
        cell, at = dict(zip(REGION, held, strict=True)) if held else None, None
        for r in sorted(rows, key=lambda r: (r["window_end"], r["cell"] is None)):
            if r["cell"] is not None:
                cell, at = r["cell"], millis(r["window_end"])
            else:
                yield Row(**{c: r[c] for c in self.columns}, hot_region=cell)
        if at is not None:
            self.cell.update(tuple(cell[n] for n in REGION))
            self.renew(at)

    def forget(self) -> None:
        self.cell.clear()


class TrendByTime(Timed):
    """As ``RisingTrend``, with the fields of an alert."""

    def __init__(self, windows: int = 3, least: float = 5.0, keep_s: int = 3600):
        self.windows, self.least, self.keep_ms = max(2, windows), least, keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", "means array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.series.get()
        means = list(held[0]) if held else []
        rows = sorted(rows, key=lambda r: r["window_start"])
        for r in rows:
            if r["cpm_avg"] is None:
                continue
            means = [*means, r["cpm_avg"]][-self.windows :]
            if len(means) == self.windows and all(a < b for a, b in zip(means, means[1:], strict=False)) and means[-1] - means[0] >= self.least:
                yield Row(
                    sensor_id=key[0], reason="rising-trend", window_start=r["window_start"], window_end=r["window_end"], cpm=r["cpm_max"], breach_count=self.windows, classification=None,
                    latitude=r["centroid_latitude"], longitude=r["centroid_longitude"], triggered_at=r["triggered_at"], geohash=key[0], hot_region=None, trend={"window_count": self.windows, "cpm_series": means, "delta": round4(means[-1] - means[0])},
                )
                means = []
        self.series.update((means,))
        self.renew(millis(rows[-1]["window_end"]))

    def forget(self) -> None:
        self.series.clear()


class Pending(StatefulProcessor):
    """What waits for one client between flushes: a queue, and the newest message of each key by recency.  It is flushed once the oldest message has waited long enough, by a batch or by a timer of the wall clock.

    The queue and the keys are bounded by their caps, so the state of a client is.  Slots are numbered as messages come, so the least number changed longest ago.
    """

    def __init__(self, flush_s: float, most_alerts: int, most_keys: int):
        self.flush_ms, self.most_alerts, self.most_keys = round(flush_s * 1000), most_alerts, most_keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "slot long", "type string, key string, order long, data string")
        self.newest = handle.getMapState("newest", "type string, key string", "slot long, order long, data string")
        self.counts = handle.getValueState("counts", "slots long, flushes long, replaced long, dropped long, filtered long, since long")

    def _known(self) -> list[int]:
        return list(self.counts.get() or (0, 0, 0, 0, 0, 0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        slots, flushes, replaced, dropped, filtered, since = self._known()
        now = timerValues.getCurrentProcessingTimeInMs()
        queue, newest = {k[0]: tuple(v) for k, v in self.queue.iterator()}, {tuple(k): tuple(v) for k, v in self.newest.iterator()}
        before, was = set(queue), dict(newest)
        for r in sorted(rows, key=lambda r: r["order"]):
            if not r["seen"]:
                filtered += 1
                continue
            slots += 1
            if r["type"] in ("clean", "aggregated") and r["key"] is not None:
                name = (r["type"], r["key"])
                if name in newest:
                    replaced += 1
                elif len(newest) >= self.most_keys:
                    del newest[min(newest, key=lambda k: newest[k][0])]
                    dropped += 1
                newest[name] = (slots, r["order"], r["data"])
            else:
                queue[slots] = (r["type"], r["key"], r["order"], r["data"])
                if len(queue) > self.most_alerts:
                    del queue[min(queue)]
                    dropped += 1
        for slot in before - set(queue):
            self.queue.removeKey((slot,))
        for slot in set(queue) - before:
            self.queue.updateValue((slot,), queue[slot])
        for name in set(was) - set(newest):
            self.newest.removeKey(name)
        for name, value in newest.items():
            if was.get(name) != value:
                self.newest.updateValue(name, value)
        if not since and (queue or newest):
            since = now
            self.handle.registerTimer(since + self.flush_ms)
        self.counts.update((slots, flushes, replaced, dropped, filtered, since))
        if since and now - since >= self.flush_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            yield from self._flush(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._flush(key)

    def _flush(self, key) -> Iterator[Row]:
        slots, flushes, *counts, _ = self._known()
        queue = sorted((k[0], *v) for k, v in self.queue.iterator())
        newest = sorted((v[0], *k, v[1], v[2]) for k, v in self.newest.iterator())
        self.queue.clear()
        self.newest.clear()
        self.counts.update((slots, flushes + 1, *counts, 0))
        for lane, part in enumerate((queue, newest)):
            for _, kind, name, order, data in part:
                yield Row(client=key[0], flush=flushes + 1, lane=lane, type=kind, key=name, order=order, data=data, replaced=counts[0], dropped=counts[1], filtered=counts[2])

    def close(self) -> None:
        pass


class Mobility(StatefulProcessor):
    """Adds sensor_type: mobile from the reading on whose box of positions so far spans over ``least_m`` metres, else fixed.  A box never shrinks, so it has no end."""

    def __init__(self, columns: list[str], order: str, least_m: float, earth_m: float):
        self.columns, self.order, self.least_m, self.earth_m = columns, order, least_m, earth_m

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.box = handle.getValueState("box", "low_lat double, high_lat double, low_lon double, high_lon double, mobile boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.box.get()
        low_lat, high_lat, low_lon, high_lon, mobile = held or (90.0, -90.0, 180.0, -180.0, False)
        for r in sorted(rows, key=lambda r: r[self.order]):
            low_lat, high_lat, low_lon, high_lon = min(low_lat, r["latitude"]), max(high_lat, r["latitude"]), min(low_lon, r["longitude"]), max(high_lon, r["longitude"])
            a = sin(radians(high_lat - low_lat) / 2) ** 2 + cos(radians(low_lat)) * cos(radians(high_lat)) * sin(radians(high_lon - low_lon) / 2) ** 2
            mobile = mobile or 2 * self.earth_m * asin(sqrt(min(a, 1.0))) > self.least_m
            yield Row(**{c: r[c] for c in self.columns if c != "sensor_type"}, sensor_type="mobile" if mobile else "fixed")
        self.box.update((low_lat, high_lat, low_lon, high_lon, mobile))

    def close(self) -> None:
        pass
