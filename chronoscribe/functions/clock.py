"""Time functions: clock text, ISO-8601, durations, ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoscribe.functions.text import _c


def instant(value: dt.datetime | str | Column) -> Column:
    """A timestamp literal; a naive ``datetime`` is read as UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.timezone.utc)
        delta = value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
        return F.timestamp_micros(F.lit(micros))
    return F.to_timestamp(F.lit(value))


def seconds_before(now: dt.datetime | str | Column, seconds: float) -> Column:
    return shift(instant(now), -seconds)


def shift(ts: Column, seconds: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(int(round(seconds * 1_000_000))))


def local_time(ts: str | Column, tz: str = "UTC") -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in zone ``tz`` (the session runs in UTC)."""
    return F.date_format(F.from_utc_timestamp(_c(ts), tz), "yyyy-MM-dd HH:mm:ss")


def clock_text(ts: str | Column, tz: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(_c(ts), tz), "HH:mm:ss")


def iso_format(ts: str | Column) -> Column:
    """UTC ISO-8601 with second precision."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_parse(col: str | Column) -> Column:
    """ISO-8601 with a fraction, else without one, else null."""
    c = _c(col)
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
    )


def epoch_seconds(ts: str | Column) -> Column:
    return F.unix_micros(_c(ts)) / F.lit(1e6)


def elapsed_seconds(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(1e6)


def duration_text(seconds: str | Column) -> Column:
    """``42s`` below a minute, else ``3m 5s``; fractions are cut off."""
    s = _c(seconds)
    whole = s.cast("long")
    return F.when(s < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(
        F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))


def range_label(minutes: str | Column) -> Column:
    """``Last 30 min`` below an hour, else ``Last 1h 5m``."""
    m = _c(minutes).cast("long")
    return F.when(m < 60, F.concat(F.lit("Last "), m.cast("string"), F.lit(" min"))).otherwise(
        F.concat(F.lit("Last "), F.floor(m / 60).cast("string"), F.lit("h "),
                 (m % 60).cast("string"), F.lit("m")))


def last_minutes(now: dt.datetime | str | Column, minutes: float) -> tuple[Column, Column]:
    """Closed range that ends at ``now``."""
    end = instant(now)
    return shift(end, -60.0 * minutes), end


def relative_time(ts: str | Column, now: str | Column | dt.datetime) -> Column:
    """Short English distance such as ``2 min ago`` or ``in 3 hr``."""
    at = instant(now) if isinstance(now, (str, dt.datetime)) else now
    micros = F.unix_micros(at) - F.unix_micros(_c(ts))
    s = F.floor(F.abs(micros) / 1_000_000)
    # Unit names with their lengths in seconds, largest first.
    units = [("yr", 31_536_000), ("mo", 2_592_000), ("wk", 604_800), ("day", 86_400),
             ("hr", 3_600), ("min", 60), ("sec", 1)]
    ladder = None
    for name, length in units:
        n = F.floor(s / length)
        label = F.concat(n.cast("string"), F.lit(" " + name))
        cond = s >= length
        ladder = F.when(cond, label) if ladder is None else ladder.when(cond, label)
    text = ladder.otherwise(F.lit("0 sec"))
    return F.when(micros < 0, F.concat(F.lit("in "), text)).otherwise(F.concat(text, F.lit(" ago")))
