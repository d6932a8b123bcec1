"""Native column expressions over dates. Times are UTC milliseconds; `now_ms` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import WS, js_trim
from jobloom.schemas import DAY_MS, THIRTY_DAYS_MS

#: ISO 8601 dates and date-times; other forms of dates depend on the implementation and are not taken.
ISO = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?)?)?\z"


def parse_iso(text: Column) -> Column:
    """Milliseconds of an ISO 8601 date (UTC where it names no zone), else null."""
    return F.when(text.rlike(ISO), F.unix_millis(text.try_cast("timestamp")))


def parse_posted_at(number: Column, text: Column, now_ms: int) -> Column:
    """Milliseconds of a posting's date: a number of up to 1e12 is in seconds; without any date, now."""
    scaled = F.when(F.isnan(number.cast("double")), F.lit(None)).when(number > 1_000_000_000_000, number).otherwise(number * 1000)
    return F.coalesce(scaled.cast("bigint"), parse_iso(text), F.lit(now_ms).cast("bigint"))


def to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_posted_on(value: Column, now_ms: int) -> Column:
    """The ISO date-time of `Posted Today`, `Posted 3 Days Ago` and the like, or of a date; null otherwise."""
    text = js_trim(value)
    said = F.lower(js_trim(F.regexp_replace(text, rf"(?i)^Posted[{WS}]+", "")))
    days = F.regexp_extract(said, rf"^(\d+)\+?[{WS}]+days?[{WS}]+ago\z", 1).try_cast("bigint")
    days = F.when(said == "today", 0).when(said == "yesterday", 1).otherwise(days)
    return to_iso(F.coalesce(parse_iso(text), F.lit(now_ms) - days * DAY_MS))


def expiry(posted_at: Column) -> Column:
    return posted_at + F.lit(THIRTY_DAYS_MS)


def format_posted(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "MMM d, yyyy")


def repair_unit(ms: Column) -> Column:
    """Seconds as milliseconds."""
    return F.when(ms < 10_000_000_000, ms * 1000).otherwise(ms)
