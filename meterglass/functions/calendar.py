"""Calendar buckets in any time zone, exact across clock changes.

A local day runs from one local midnight to the next; where midnight is skipped it starts when the clock goes on, where
it comes twice at the first. A row's day is its local date unless the clock was set back across midnight, in which
case the boundaries decide. Rows get their bucket from this key; no range join is needed. The session zone is UTC.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exprs as X

HOUR = 3_600_000
FIRST, LAST, MOST_DAYS = date(1970, 1, 1), date(2101, 1, 1), 3660


class RangeError(ValueError):
    """A report range that isn't allowed."""


@dataclass(frozen=True)
class LocalRange:
    """Local dates from start up to, and without, end, in a named zone."""

    start: date
    end: date
    zone: str = "UTC"
    week_start: str = "monday"

    def __post_init__(self) -> None:
        if self.end <= self.start:
            raise RangeError("the range is empty")
        if self.start < FIRST or self.end > LAST:
            raise RangeError("years from 1970 to 2100 are supported")
        if (self.end - self.start).days > MOST_DAYS:
            raise RangeError(f"more than {MOST_DAYS} days")
        if self.zone not in available_timezones():
            raise RangeError(f"unknown time zone {self.zone}")
        if self.week_start not in ("monday", "sunday"):
            raise RangeError("weeks start on monday or sunday")


def day_start(day: Column, zone: str) -> Column:
    """Epoch milliseconds at which a local date begins."""
    return F.unix_millis(F.to_utc_timestamp(day.cast("timestamp"), zone))


def local_date(ms: Column, zone: str) -> Column:
    """The local day that epoch milliseconds belong to."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))
    return F.when(ms >= day_start(F.date_add(day, 1), zone), F.date_add(day, 1)).when(ms < day_start(day, zone), F.date_sub(day, 1)).otherwise(day)


def in_range(ms: Column, span: LocalRange) -> Column:
    return (ms >= day_start(F.lit(span.start), span.zone)) & (ms < day_start(F.lit(span.end), span.zone))


def period(day: Column, unit: str, span: LocalRange) -> Column:
    """First date of the week or month that a date is in."""
    if unit == "day":
        return day
    if unit == "month":
        return F.trunc(day, "month")
    return F.date_sub(day, F.weekday(day) if span.week_start == "monday" else F.dayofweek(day) - 1)


def bucket_start(ms: Column, unit: str, span: LocalRange) -> Column:
    """Start of the bucket that a time in the range belongs to."""
    day = local_date(ms, span.zone)
    if unit == "hour":
        start = day_start(day, span.zone)
        return start + F.floor((ms - start) / HOUR) * HOUR
    return day_start(F.greatest(period(day, unit, span), F.lit(span.start)), span.zone)


def offset_text(ms: Column, zone: str) -> Column:
    minutes = F.floor((F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone)) - ms) / 60_000)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


def label(start: Column, first: Column, unit: str, span: LocalRange) -> Column:
    """Name of a bucket. first: first date of the whole week or month, even where the range cuts it."""
    if unit == "hour":
        return F.concat(F.date_format(F.from_utc_timestamp(F.timestamp_millis(start), span.zone), "yyyy-MM-dd'T'HH:mm"), offset_text(start, span.zone))
    if unit == "day":
        return F.date_format(first, "yyyy-MM-dd")
    if unit == "month":
        return F.date_format(first, "yyyy-MM")
    if span.week_start == "monday":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), first).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(first).cast("string"), 2, "0"))
    sunday_week = F.floor((F.dayofyear(first) + 6 - (F.dayofweek(first) - 1)) / 7)
    return F.concat(F.year(first).cast("string"), F.lit("-W"), F.lpad(sunday_week.cast("string"), 2, "0"))


def spine(spark: SparkSession, span: LocalRange, unit: str) -> DataFrame:
    """(bucket_start, bucket_end, label) of every bucket of the range; days that a zone skips have none."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(span.start), F.date_sub(F.lit(span.end), 1))).alias("day"))
    days = days.select("day", day_start(F.col("day"), span.zone).alias("s"), day_start(F.date_add("day", 1), span.zone).alias("e")).where("s < e")
    if unit == "hour":
        n = F.ceil((F.col("e") - F.col("s")) / HOUR) - 1
        rows = days.select("day", "e", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("i"), "s").select((F.col("s") + F.col("i") * HOUR).alias("bucket_start"), F.least(F.col("s") + (F.col("i") + 1) * HOUR, F.col("e")).alias("bucket_end"), F.col("day").alias("first"))
    else:
        rows = days.groupBy(period(F.col("day"), unit, span).alias("first")).agg(F.min("s").alias("bucket_start"), F.max("e").alias("bucket_end"))
    return rows.select("bucket_start", "bucket_end", label(F.col("bucket_start"), F.col("first"), unit, span).alias("label"))


def local_text(ms: Column, zone: str) -> Column:
    """YYYY-MM-DD HH:mm:ss in the zone; in UTC if there is no such zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone if zone in available_timezones() else "UTC"), "yyyy-MM-dd HH:mm:ss")


def rezoned_text(stamp: Column, zone: str) -> Column:
    """A time with offset as YYYY-MM-DD HH:mm:ss in the zone; anything else stays as it is."""
    ms = F.when(stamp.rlike(X.RFC3339), X.instant_ms(stamp))
    return F.coalesce(local_text(ms, zone), stamp)


def default_unit(days: int) -> str:
    return "hour" if days <= 1 else "day" if days <= 31 else "week" if days <= 92 else "month"
