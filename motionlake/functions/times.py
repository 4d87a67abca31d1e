"""Timestamps: zones, parsing of mixed texts, durations and compact keys. Micro-second integers where exactness matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Text forms of timestamps, tried in this order.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")


def micros(time: Column | str) -> Column:
    """Micro-seconds since the epoch, of a timestamp with or without a zone (taken as UTC)."""
    return F.unix_micros(F.to_timestamp(F.col(time) if isinstance(time, str) else time))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long"))


def to_utc(local: Column, zone: str) -> Column:
    """Local wall time to UTC; an ambiguous hour is its first."""
    return F.to_utc_timestamp(local, zone)


def to_local(utc: Column, zone: str) -> Column:
    return F.from_utc_timestamp(utc, zone)


def parse_mixed(text: Column, zone: str | None = None) -> Column:
    """The first form that fits; text without an offset is local time of `zone` (UTC if none). Null if none fits."""
    trimmed = F.trim(text)
    zoned = F.coalesce(*(F.try_to_timestamp(trimmed, F.lit(f)) for f in FORMATS[:3]))
    naive = F.coalesce(*(F.try_to_timestamp(trimmed, F.lit(f)) for f in FORMATS[3:]))
    has_offset = trimmed.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(has_offset, zoned).otherwise(to_utc(naive, zone) if zone else naive)


def rfc3339(utc: Column) -> Column:
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact(utc: Column) -> Column:
    return F.date_format(utc, "yyyyMMdd'T'HHmmss")


def seconds_between(start: Column | str, stop: Column | str) -> Column:
    return (micros(stop) - micros(start)) / SECOND


def minutes_between(start: Column | str, stop: Column | str) -> Column:
    return F.round(seconds_between(start, stop) / 60, 6)


def safe_token(text: Column) -> Column:
    """Text for a file or block name: runs of other characters become one underscore."""
    return F.trim(F.regexp_replace(text.cast("string"), r"[^A-Za-z0-9]+", "_"), F.lit("_"))


def block_id(reference: Column, start: Column, stop: Column) -> Column:
    return F.concat_ws("_", safe_token(reference), compact(start), compact(stop))
