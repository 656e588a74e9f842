"""Clock changes, skipped dates and clipped weeks, as published time zone rules have them."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from meterglass.functions import calendar as C


def spine(spark, a, b, zone, unit, week="monday"):
    return spark_rows(C.spine(spark, C.LocalRange(a, b, zone, week), unit))


def spark_rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    "zone,day,hours,tail",
    [("America/New_York", date(2026, 3, 8), 23, 60), ("America/New_York", date(2026, 11, 1), 25, 60), ("Australia/Lord_Howe", date(2026, 10, 4), 24, 30), ("Australia/Lord_Howe", date(2026, 4, 5), 25, 30)],
)
def test_hours_of_changing_days(spark, zone, day, hours, tail):
    got = spine(spark, day, date.fromordinal(day.toordinal() + 1), zone, "hour")
    assert len(got) == hours
    assert (got[-1][1] - got[-1][0]) // 60_000 == tail


def test_repeated_hour_has_two_labels(spark):
    labels = [r[2] for r in spine(spark, date(2026, 11, 1), date(2026, 11, 2), "America/New_York", "hour")]
    assert "2026-11-01T01:00-04:00" in labels and "2026-11-01T01:00-05:00" in labels


def test_skipped_date_has_no_bucket(spark):
    labels = [r[2] for r in spine(spark, date(2011, 12, 29), date(2012, 1, 1), "Pacific/Apia", "day")]
    assert labels == ["2011-12-29", "2011-12-31"]


def test_weeks_and_months_are_clipped(spark):
    weeks = spine(spark, date(2026, 7, 29), date(2026, 8, 12), "UTC", "week")
    assert [w[2] for w in weeks] == ["2026-W31", "2026-W32", "2026-W33"]
    months = spine(spark, date(2026, 7, 31), date(2026, 9, 2), "UTC", "month")
    assert [m[2] for m in months] == ["2026-07", "2026-08", "2026-09"] and months[0][1] - months[0][0] == 86_400_000


def test_labels_of_an_instant(spark):
    t = F.lit(1785468844419)
    span = C.LocalRange(date(2026, 7, 1), date(2026, 8, 30), "Asia/Shanghai")
    sunday = C.LocalRange(date(2026, 7, 1), date(2026, 8, 30), "Asia/Shanghai", "sunday")
    day = C.local_date(t, span.zone)
    row = spark.range(1).select(day.cast("string"), C.label(t, C.period(day, "week", span), "week", span), C.label(t, C.period(day, "week", sunday), "week", sunday), C.label(t, day, "month", span)).first()
    assert tuple(row) == ("2026-07-31", "2026-W31", "2026-W30", "2026-07")


def test_fall_back_across_midnight(spark):
    """St John's set its clocks back at 00:01: for an hour, local dates re-enter the day before."""
    span = C.LocalRange(date(2005, 10, 28), date(2005, 11, 2), "America/St_Johns")
    days = spine(spark, span.start, span.end, span.zone, "day")
    times = spark.range(days[0][0], days[-1][1], 600_000).withColumn("b", C.bucket_start(F.col("id"), "day", span))
    for s, e, _ in days:
        assert times.where((F.col("id") >= s) & (F.col("id") < e) & (F.col("b") != s)).count() == 0


@pytest.mark.parametrize("bad", [(date(2024, 1, 2), date(2024, 1, 2), "UTC"), (date(1969, 1, 1), date(1970, 1, 2), "UTC"), (date(2000, 1, 1), date(2020, 1, 1), "UTC"), (date(2024, 1, 1), date(2024, 1, 2), "Mars/Base")])
def test_bad_ranges(bad):
    with pytest.raises(C.RangeError):
        C.LocalRange(*bad)


def test_unit_by_span_and_local_texts(spark):
    assert [C.default_unit(d) for d in (1, 2, 31, 32, 92, 93)] == ["hour", "day", "day", "week", "week", "month"]
    stamps = {"2026-07-31T03:34:04Z": "2026-07-31 11:34:04", "2026-07-31T03:34:04.5+02:00": "2026-07-31 09:34:04", "2026-07-31T03:34:04": "2026-07-31T03:34:04", "12:00": "12:00", "1785468844419": "1785468844419"}
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    assert {r.s: r.t for r in df.select("s", C.rezoned_text(F.col("s"), "Asia/Shanghai").alias("t")).collect()} == stamps
    assert df.select(C.rezoned_text(F.lit("2026-07-31T03:34:04Z"), "Mars/Base")).first()[0] == "2026-07-31 03:34:04"
