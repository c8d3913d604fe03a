"""Times: milliseconds since 1970 in and out, days that begin at 04:00, weeks on Monday; all in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_HOUR = 4


def stamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def millis(ts: Column) -> Column:
    """Of a timestamp with or without zone."""
    return F.unix_millis(ts.cast("timestamp"))


def day_start(ms: Column) -> Column:
    """04:00 at or before a time."""
    return millis(F.date_trunc("DAY", stamp(ms) - F.expr(f"INTERVAL {DAY_HOUR} HOURS")) + F.expr(f"INTERVAL {DAY_HOUR} HOURS"))


def week_start(ms: Column) -> Column:
    """Monday 00:00 at or before a time."""
    return millis(F.date_trunc("WEEK", stamp(ms)))


def webkit_to_unix(us: Column) -> Column:
    """Microseconds since 1601 to milliseconds since 1970; 0 for null, 0 and below."""
    return F.when(us > 0, F.floor(us / 1000) - 11_644_473_600_000).otherwise(0).cast("long")


def iso(ms: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(stamp(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clock(ms: Column) -> Column:
    return F.lower(F.date_format(stamp(ms), "h:mma"))


def time_range(a: Column, b: Column) -> Column:
    """Start to end on the clock; a shared am or pm once, a later day marked, a reversed range told."""
    days = F.datediff(F.to_date(stamp(b)), F.to_date(stamp(a)))
    half = lambda x: F.lower(F.date_format(stamp(x), "a"))
    left = F.when(half(a) == half(b), F.date_format(stamp(a), "h:mm")).otherwise(clock(a))
    mark = F.when(b < a, " — end before start").when(days == 0, "").when(days == 1, " (next day)").otherwise(F.concat(F.lit(" (+"), days.cast("string"), F.lit(" days)")))
    return F.concat(left, F.lit("–"), clock(b), mark)


def day_label(day: Column, today: Column) -> Column:
    """Today, Yesterday or a short date, for days as given by day_start."""
    days = F.datediff(F.to_date(stamp(today)), F.to_date(stamp(day)))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise(F.date_format(stamp(day), "EEE, MMM d"))


def is_paused(until: Column, indefinite: Column, now: Column) -> Column:
    return F.coalesce(indefinite, F.lit(False)) | F.coalesce(now < until, F.lit(False))


def remaining(ms: Column) -> Column:
    minutes = F.ceil(ms / 60_000)
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(hours, F.lit("h"))).otherwise(F.concat(hours, F.lit("h "), rest.cast("string"), F.lit("m")))


def ago(then: Column, now: Column) -> Column:
    minutes = F.floor((now - then) / 60_000)
    hours = F.floor(minutes / 60)
    text = lambda x: x.cast("string")
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(text(minutes), F.lit(" min ago"))).when(hours < 24, F.concat(text(hours), F.lit("h "), text(minutes % 60), F.lit("m ago"))).otherwise(F.concat(text(F.floor(hours / 24)), F.lit("d ago")))


def opacity(score: Column, low: float = 0.30, high: float = 0.95, floor: float = 0.55) -> Column:
    """A list's opacity by its best score: clamped, then linear from ``floor`` to 1."""
    clamped = F.least(F.lit(high), F.greatest(F.lit(low), score))
    return floor + (clamped - low) / (high - low) * (1 - floor)


def timeline_x(ms: Column, day: Column) -> Column:
    """A time's place on its day's line, in percent."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (ms - day) / (24 * 3600 * 1000) * 100))


def week_label(week: Column) -> Column:
    """A week's short date, by its Monday."""
    return F.date_format(stamp(week), "MMM d")


def took(ms: Column) -> Column:
    """A duration: milliseconds below a second, else seconds with two places."""
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.format_string("%.2fs", ms.cast("double") / 1000))


def calendar_day_start(ms: Column) -> Column:
    """Midnight at or before a time."""
    return millis(F.date_trunc("DAY", stamp(ms)))


def to_input(ms: Column) -> Column:
    """A time as a date-and-time field shows it: local, to the minute."""
    return F.date_format(stamp(ms), "yyyy-MM-dd'T'HH:mm")


def from_input(value: Column) -> Column:
    """The time of a date-and-time field; null if it is empty or unreadable."""
    return millis(F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss"))))
