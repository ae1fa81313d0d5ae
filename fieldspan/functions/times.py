"""Column expressions for the spellings of time that position logs use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: larger numbers are milliseconds.
MILLIS_FROM = 1e11
#: What is accepted besides ISO 8601 and plain numbers.
PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss")


def to_epoch(s: Column) -> Column:
    """Seconds since 1970 of a text; null if it is none of the spellings. Without a zone it is UTC."""
    s = F.trim(s)
    number = F.when(s.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), s.try_cast("double"))
    iso = F.regexp_replace(s, r"(\.\d{6})\d+", "$1")
    moment = F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)?$"), iso.try_cast("timestamp")), *(F.try_to_timestamp(s, F.lit(p)) for p in PATTERNS)
    )
    return F.when(number > MILLIS_FROM, number / 1000).otherwise(F.coalesce(number, F.unix_micros(moment) / 1e6))


def iso_utc(t: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.floor(t * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_start(day: Column, offset_hours: Column) -> Column:
    """The first second of a local day at a fixed offset; its end is 86,400 s later."""
    return F.unix_micros(day.cast("timestamp")) / 1e6 - offset_hours * 3600


def zoned_day_start(day: Column, zone: str) -> Column:
    return F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), zone)) / 1e6


def clean_prefix(s: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), F.lit("_"))
