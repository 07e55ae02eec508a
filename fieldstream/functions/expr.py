"""Column expressions over readings, cells and alerts.  All are native, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds before any configuration, accepted units, plausible counts, the earth's radius in metres.
WARN, DANGER = 100.0, 1000.0
UNITS = ("cpm", "mSv/h", "uSv/h")
MOST_CPM = 1_000_000.0
EARTH_M = 6_371_000.0
# Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
LEVELS = ("SAFE", "WARN", "DANGER")


# Fixed value: what counts as white space at the ends of a text.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
#: A decimal number, single underscores between its digits, or a name of infinity or NaN; no suffix of a type and no hexadecimal.
NUMBER = r"^[+-]?(?:(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|(?i:inf|infinity|nan))$"
#: A whole date, and after it perhaps a time and an offset.
TIME = r"^(?!0000)\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:\d{2})?)?$"


def stripped(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(WHITE))


def number(c: Column | str) -> Column:
    """Text to double; blanks and whatever is no decimal number become null."""
    text = stripped(F.col(c) if isinstance(c, str) else c)
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp, null for anything else (a time without a date, a year alone, names of zones).

    A date, T or a space, hours with or without minutes and seconds, any number of fraction digits, Z or an offset; without one it is UTC.
    """
    text = stripped(text)
    whole = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    for shorter in (r"^(\S{10}[T ]\d{2})(?=$|[Z+-])", r"^(\S{10}[T ]\d{2}:\d{2})(?=$|[Z+-])"):
        whole = F.regexp_replace(whole, shorter, "$1:00")
    return F.when(text.rlike(TIME), whole.try_cast("timestamp"))


def normal_time(text: Column) -> Column:
    """The text form that events carry: trimmed, +00:00 for each Z, T between date and time; blank becomes null."""
    plain = F.replace(stripped(text), F.lit("Z"), F.lit("+00:00"))
    return F.nullif(F.regexp_replace(plain, r"(?s)^(.{10}) (?=.)", "$1T"), F.lit(""))


def millis(ts: Column) -> Column:
    """Epoch milliseconds, truncated."""
    return F.unix_millis(ts)


def iso(ts: Column) -> Column:
    """UTC ISO text with +00:00 (the session's zone is UTC)."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def round_to(x: Column, digits: int) -> Column:
    """Half up on the binary value; the same expression in other engines gives the same double."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def classify(cpm: Column, warn: Column | float = WARN, danger: Column | float = DANGER) -> Column:
    """SAFE, WARN or DANGER; null for a null."""
    return F.when(cpm.isNull(), F.lit(None).cast("string")).when(cpm >= danger, "DANGER").when(cpm >= warn, "WARN").otherwise("SAFE")


def severity(level: Column) -> Column:
    """1 to 3; null for an unknown level."""
    return F.when(level == "SAFE", 1).when(level == "WARN", 2).when(level == "DANGER", 3)


def level_name(rank: Column) -> Column:
    return F.when(rank == 1, "SAFE").when(rank == 2, "WARN").when(rank == 3, "DANGER")


def geohash(lat: Column, lon: Column, precision: int = 5) -> Column:
    """Cell name of ``precision`` letters; null for a null coordinate.

    A point on a cell's lower edge belongs to the cell below, as a bisection
    with a strict comparison puts it.
    """
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2

    def index(x: Column, low: float, span: float, bits: int) -> Column:
        top = (1 << bits) - 1
        return F.least(F.greatest(F.ceil((x - low) / span * float(1 << bits)) - 1, F.lit(0)), F.lit(top)).cast("long")

    x, y = index(lon, -180.0, 360.0, lon_bits), index(lat, -90.0, 180.0, lat_bits)
    letters = []
    for k in range(precision):
        code = F.lit(0).cast("long")
        for b in range(5 * k, 5 * k + 5):
            source, bits = (x, lon_bits) if b % 2 == 0 else (y, lat_bits)
            code = code + F.shiftright(source, bits - 1 - b // 2).bitwiseAND(F.lit(1)) * (1 << (4 - b % 5))
        letters.append(F.substring(F.lit(BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*letters))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def dedup_key(md5sum: Column, captured_at: Column) -> Column:
    """The checksum, or else the time."""
    return F.coalesce(F.nullif(md5sum, F.lit("")), F.concat(F.lit("captured_at:"), captured_at.cast("string")))


def sensor_of(sensor_id: Column, device_id: Column) -> Column:
    """sensor_id, or a device_id that is neither blank nor "0"."""
    device = stripped(device_id)
    return F.coalesce(blank_to_null(sensor_id), F.when((device != "") & (device != "0"), device))


def checked_unit(unit: Column) -> Column:
    return F.when(stripped(unit).isin(*UNITS), stripped(unit))


def plausible(cpm: Column) -> Column:
    """Between 0 and a million; a null passes, text that is no number and NaN don't."""
    value = F.when(F.typeof(cpm) == "string", number(cpm.cast("string"))).otherwise(cpm.try_cast("double"))  # the optimizer takes one of them
    return cpm.isNull() | F.coalesce(value.between(0.0, MOST_CPM) & ~F.isnan(value), F.lit(False))


def valid_position(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def in_area(lat: Column, lon: Column, area: Column) -> Column:
    """Inside an inclusive box; a null box holds everything."""
    inside = lat.between(area["min_lat"], area["max_lat"]) & lon.between(area["min_lon"], area["max_lon"])
    return area.isNull() | F.coalesce(inside, F.lit(False))


def in_timespan(ts: Column, span: Column) -> Column:
    """In [start, end) by truncated milliseconds; a null span holds everything."""
    return span.isNull() | F.coalesce((millis(ts) >= millis(span["start"])) & (millis(ts) < millis(span["end"])), F.lit(False))


def in_backfill(ts: Column, start: str | None = None, end: str | None = None) -> Column:
    """In [start, end], both inclusive; a missing time passes."""
    ok = F.lit(True)
    if start:
        ok = ok & (ts >= F.lit(start).cast("timestamp"))
    if end:
        ok = ok & (ts <= F.lit(end).cast("timestamp"))
    return ts.isNull() | ok


def track_time(low: Column, high: Column, fraction: Column) -> Column:
    """The place of a fraction, held within 0 and 1, on the way from low to high."""
    return low + F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)) * (high - low)


def region_summary(cell: Column) -> Column:
    """The six fields of a cell that an alert carries, or null without a cell."""
    names = ("cpm_avg", "cpm_max", "count", "worst_classification", "centroid_latitude", "centroid_longitude")
    return F.when(cell.isNotNull(), F.struct(*(cell[n].alias(n) for n in names)))
