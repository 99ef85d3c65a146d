"""Strings and times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatstrata import constants as C

# Largest instant, in epoch seconds, a JavaScript date can hold.
_MAX_EPOCH_SECONDS = 8_640_000_000_000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(text, F.lit(C.WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def non_blank(text: Column) -> Column:
    """The text, or null when it has only white space."""
    return F.when(strip(text) != "", text)


def clip_text(text: Column, limit: int, suffix: str = "") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(suffix))).otherwise(text)


def one_line_preview(text: Column, limit: int = C.ONE_LINE_CHARS) -> Column:
    return clip_text(strip(F.regexp_replace(text, r"\s+", " ")), limit, "...")


def parse_ts(value: Column, epoch_default: bool = False) -> Column:
    """ISO-8601 text to a timestamp; bad input gives null (or the epoch)."""
    ts = value.try_cast("timestamp")
    return F.coalesce(ts, F.timestamp_seconds(F.lit(0))) if epoch_default else ts


def epoch_ts(seconds: Column, epoch_default: bool = False) -> Column:
    number = seconds.try_cast("double")
    ts = F.when(F.abs(number) <= _MAX_EPOCH_SECONDS, F.timestamp_seconds(number))
    return F.coalesce(ts, F.timestamp_seconds(F.lit(0))) if epoch_default else ts


def resolve_title(index_name: Column, history_text: Column, first_message: Column, session_id: Column) -> Column:
    return F.coalesce(non_blank(index_name), non_blank(history_text), non_blank(first_message), session_id)


def display_title(title: Column, session_id: Column) -> Column:
    return F.coalesce(non_blank(strip(title)), session_id)


def normalize_role(kind: Column) -> Column:
    """Role of an event type or response role; null for every other value."""
    return F.when(kind.isin("user_message", "user"), "user").when(kind.isin("agent_message", "assistant"), "assistant")


def fingerprint(content: Column) -> Column:
    return F.when(F.length(content) > 0, F.left(F.sha2(content, 256), F.lit(12))).otherwise("none")


def config_string(text: Column, key: str) -> Column:
    """First ``key = "value"`` line of a config text; null if there is none."""
    found = F.regexp_extract(text, rf'(?m)^\s*{key}\s*=\s*"([^"]*)"\s*$', 1)
    return F.when(found != "", found)


def freshness(updated: Column, exists: Column, now: Column) -> Column:
    days = (F.unix_micros(now) - F.unix_micros(updated)) / F.lit(86_400_000_000)
    return (
        F.when(~F.coalesce(exists, F.lit(False)), "missing")
        .when(updated.isNull(), "stale")
        .when(days < 1, "today")
        .when(days > 7, "stale")
        .otherwise("recent")
    )


def relative_age(updated: Column, now: Column) -> Column:
    """Age bucket as ``<number><unit>``; a date when it lies ahead or is over 30 days old."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(updated)) / F.lit(60_000_000))
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)

    def bucket(number: Column, unit: str) -> Column:
        return F.concat(number.cast("string"), F.lit(unit))

    return (
        F.when(updated.isNull(), "-")
        .when(minutes < 0, F.date_format(updated, "yyyy-MM-dd HH:mm:ss"))
        .when(minutes < 1, "now")
        .when(minutes < 60, bucket(minutes, "m"))
        .when(hours < 24, bucket(hours, "h"))
        .when(days < 7, bucket(days, "d"))
        .when(days < 30, bucket(F.floor(days / 7), "w"))
        .otherwise(F.date_format(updated, "yyyy-MM-dd"))
    )
