"""Instants, Indian days and the written dates found in pages and answers.

Every function takes ``as_of`` where "now" matters, so a rerun gives the same rows.
The session zone must be UTC.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirefold.functions.text import blank_to_null, col, let, squeeze

# The zone of day bounds, how dates are written, and words that tell of an event.
IST = "Asia/Kolkata"
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
WRITTEN_DATE = (rf"(?i)\b(?:{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}"
                rf"|\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH},?\s+\d{{4}})\b")
_ZONED = r"(?i)(z|gmt|utc|[+-]\d{2}:?\d{2})$"
READ_MORE = r"(?i)\bread more( about)?\b|\b\d+\s+mins?( read)?\b|\bopen in a new tab\b"
CARD_DATE = rf"(?i)^\s*{MONTH}\s+\d{{1,2}}\s*\\"
EVENT_WORDS = (
    r"(?i)\b(events?|summit|demo ?days?|meetups?|webinars?|conference|conclave|workshops?|"
    r"office hours|bootcamp|hackathon|masterclass|mixer|roundtable|fireside chat|"
    r"rsvp|register now)\b")
ANY_DATE = (rf"(?i)\b(\d{{1,2}}(st|nd|rd|th)?\s+{MONTH}|{MONTH}\s+\d{{1,2}}(st|nd|rd|th)?\b"
            r"|\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4})")


def instant(value: dt.datetime | Column | str) -> Column:
    """A literal instant. A datetime without a zone is read as UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.to_timestamp(F.lit(str(value)))


def day_bounds(start: dt.date | str | None, end: dt.date | str | None
               ) -> tuple[Column | None, Column | None]:
    """[since, until) of a range of Indian days, as UTC literals Catalyst can push down."""
    def midnight(day, plus: int) -> Column:
        day = dt.date.fromisoformat(day) if isinstance(day, str) else day
        stamp = dt.datetime.combine(day + dt.timedelta(days=plus), dt.time.min)
        return instant(stamp - dt.timedelta(hours=5, minutes=30))
    if start and end and str(start) > str(end):
        raise ValueError("start is after end")
    return (midnight(start, 0) if start else None, midnight(end, 1) if end else None)


def in_days(ts: Column | str, start=None, end=None) -> Column:
    """The window predicate. Undated rows fail it once a bound is set."""
    since, until = day_bounds(start, end)
    out = F.lit(True)
    if since is not None:
        out = out & (col(ts) >= since)
    if until is not None:
        out = out & (col(ts) < until)
    return out


def indian_day(ts: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), IST))


def reader_day(ts: Column | str, offset_minutes: int) -> Column:
    return F.to_date(col(ts) + F.make_dt_interval(mins=F.lit(offset_minutes)))


def read_time(c: Column | str, zone: str = IST) -> Column:
    """struct(ts, local_day) of a written time; zone-less times are in ``zone``.

    Reads ISO stamps, RFC 822 dates and written dates with an optional clock.
    Anything else is null.
    """
    text = squeeze(c)
    text = F.regexp_replace(text, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    text = F.regexp_replace(
        text, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", "$1")
    text = F.regexp_replace(text, r"(?i)(\d)(st|nd|rd|th)\b", "$1")
    text = F.regexp_replace(text, r"^([A-Za-z]{3}) (\d{1,2}),? (\d{4})", "$2 $1 $3")
    text = F.regexp_replace(text, r"^(\d{1,2}[ -])([A-Za-z]{3}),?([ -])(\d{4})", "$1$2$3$4")
    text = F.regexp_replace(text, r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})", "$1 $2 $3")
    text = F.regexp_replace(text, r"^(\d{1,2} [A-Za-z]{3} \d{4}),? (?:at )?", "$1 ")
    return let(text, lambda t: _settle(t, zone))


def _settle(text: Column, zone: str) -> Column:
    shape = F.struct(text.alias("text"), (text.rlike(_ZONED) & text.rlike(r"\d:\d{2}")).alias("zoned"),
                     text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}|$)").alias("iso"))
    return let(shape, lambda s: _placed(s["text"], s["zoned"], s["iso"], zone))


def _placed(text: Column, zoned: Column, iso: Column, zone: str) -> Column:
    iso_text = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    clock = F.trim(F.regexp_replace(text, r"(?i)\s*(z|gmt|utc|ist|[+-]\d{2}:?\d{2})$", ""))
    offset = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 0)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = sign * (F.substring(offset, 2, 2).try_cast("int") * 60
                      + F.regexp_extract(offset, r"(\d{2})$", 1).try_cast("int"))
    written = let(clock, _written)
    wall = F.when(iso, F.regexp_replace(iso_text, _ZONED, "").try_cast("timestamp")
                  ).otherwise(written)

    def placed(w: Column) -> Column:
        ts = (F.when(w.isNull(), None)
              .when(zoned & iso, iso_text.try_cast("timestamp"))
              .when(zoned & (offset != ""), w - F.make_dt_interval(mins=minutes))
              .when(zoned, w)
              .otherwise(F.to_utc_timestamp(w, zone)))
        return F.struct(ts.alias("ts"), F.to_date(w).alias("local_day"))

    return let(wall, placed)


def _written(clock: Column) -> Column:
    """A written day with an optional clock. A form is tried on what may be of its shape only, as
    every form that fails costs an exception."""
    timed, half = clock.contains(":"), clock.rlike("(?i)m$")
    seconds = timed & clock.rlike(":.*:")
    forms = (("d MMM yyyy", ~timed & ~half), ("d MMM yyyy HH:mm:ss", seconds), ("d MMM yyyy HH:mm", timed & ~seconds & ~half),
             ("d MMM yyyy h:mm a", timed & ~seconds & half), ("d MMM yyyy h:mma", timed & ~seconds & half),
             ("d MMM yyyy h a", ~timed & half), ("d MMM yyyy ha", ~timed & half))
    tried = F.coalesce(*[F.when(fits, F.try_to_timestamp(clock, F.lit(form))) for form, fits in forms])
    return F.when(clock.rlike(r"^[+-]?\d+ \D"), tried)


def published_time(c: Column | str, as_of) -> Column:
    """struct(ts, approx): "3 hours ago", "yesterday" or a written date."""
    return let(squeeze(c), lambda t: _published(t, as_of))


def _published(said: Column, as_of) -> Column:
    text = F.lower(said)
    now = instant(as_of)
    amount = F.regexp_replace(
        F.regexp_extract(text, r"^(\d+|an?) (second|minute|min|hour|day|week|month|year)s? ago$", 1),
        "^an?$", "1").try_cast("int")
    unit = F.regexp_extract(text, r"^(\d+|an?) (second|minute|min|hour|day|week|month|year)s? ago$",
                            2)
    local = F.from_utc_timestamp(now, IST)

    def back(**parts) -> Column:
        return F.to_utc_timestamp(local - F.make_interval(**parts), IST)

    relative = (F.when(unit == "second", back(secs=amount))
                .when(unit.isin("minute", "min"), back(mins=amount))
                .when(unit == "hour", back(hours=amount))
                .when(unit == "day", back(days=amount))
                .when(unit == "week", back(weeks=amount))
                .when(unit == "month", back(months=amount))
                .when(unit == "year", back(years=amount))
                .when(text == "yesterday", back(days=F.lit(1)))
                .when(text.isin("today", "now", "just now"), now))
    ts = F.coalesce(relative, read_time(said)["ts"])
    words = text.rlike(r"\b(ago|hour|hours|minute|minutes|day|days|week|weeks|month|months"
                       r"|yesterday|today)\b")
    return let(ts, lambda v: F.struct(
        v.alias("ts"), F.coalesce(v.isNotNull() & words, F.lit(False)).alias("approx")))


def event_time(c: Column | str) -> Column:
    """struct(ts, date_only). No zone means Indian time; no clock means the whole day."""
    def said(text: Column) -> Column:
        return F.struct(read_time(text).alias("read"), text.rlike(
            r"(?i)\d{1,2}:\d{2}|\d\s*(am|pm)\b").alias("clock"))

    def placed(of: Column) -> Column:
        read, has_clock = of["read"], of["clock"]
        ts = F.when(has_clock, read["ts"]).otherwise(
            F.to_utc_timestamp(read["local_day"].cast("timestamp"), IST))
        return F.struct(ts.alias("ts"), F.coalesce(read["ts"].isNotNull() & ~has_clock, F.lit(False))
                        .alias("date_only"))

    return let(let(F.substring(squeeze(c), 1, 80), said), placed)


def date_in_text(c: Column | str) -> Column:
    """The first written date inside a text, as the UTC start of that Indian day."""
    return read_time(blank_to_null(F.regexp_extract(col(c), WRITTEN_DATE, 0)))["ts"]


def tidy_title(c: Column | str) -> Column:
    """A card's link text without its date and its "read more"."""
    text = F.regexp_replace(col(c), CARD_DATE, " ")
    text = F.replace(text, F.lit("\\"), F.lit(" "))

    # Every written date has a year, and the other phrases one of these words: most texts need no replacing.
    def undated(t: Column) -> Column:
        return F.when(t.rlike(r"\d{4}"), F.regexp_replace(t, WRITTEN_DATE, " ")).otherwise(t)

    def unasked(t: Column) -> Column:
        said = let(F.lower(t), lambda low: low.contains("read more") | low.contains("min") | low.contains("new tab"))
        return F.when(said, F.regexp_replace(t, READ_MORE, " ")).otherwise(t)
    text = let(let(text, undated), unasked)
    return F.substring(F.btrim(squeeze(text), F.lit(" -|·,.")), 1, 300)


def mentions_events(c: Column | str) -> Column:
    return col(c).rlike(EVENT_WORDS) & col(c).rlike(ANY_DATE)


def _seconds(a: Column, b: Column) -> Column:
    return a.cast("double") - b.cast("double")


def read_ago(ts: Column | str, as_of) -> Column:
    hours = _seconds(instant(as_of), col(ts)) / 3600
    return (F.when(col(ts).isNull(), "not read yet")
            .when(hours < 1, "read just now")
            .when(hours < 48, F.format_string("read %dh ago", F.round(hours).cast("int")))
            .otherwise(F.format_string("read %d days ago", F.round(hours / 24).cast("int"))))


def refreshed_ago(ts: Column | str, as_of, interval_hours: int) -> Column:
    hours = _seconds(instant(as_of), col(ts)) / 3600
    days = F.floor(hours / 24).cast("int")
    return (F.when(col(ts).isNull(), "Not refreshed yet")
            .when(hours < 1, F.format_string("Refreshed %d min ago", F.greatest(
                F.lit(1), F.round(hours * 60).cast("int"))))
            .when(hours < 24, F.format_string("Refreshed %dh ago", F.round(hours).cast("int")))
            .otherwise(F.format_string(
                f"Refreshed %d day%s ago (expected every {interval_hours}h)", days,
                F.when(days > 1, "s").otherwise(""))))
