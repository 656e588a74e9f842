"""Aggregates beside the archive: the same answers as from all records, and little that is read for them."""

import random
from datetime import date

from pyspark.sql import functions as F
from test_sources import usage, usage_row

from meterglass.functions.calendar import LocalRange
from meterglass.operators import reports
from meterglass.plans import inputs
from meterglass.streaming import archive, rollup

DAY = 86_400_000
START = 1_704_067_200_000  # the first of January 2024 in UTC


def plain(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in names)) for r in df.collect()), key=str)


def records(rng, n, keys, late=0):
    out = []
    for i in range(n):
        model = rng.choice((("anthropic", "claude-opus-4-8"), ("p", "q")))
        paid = rng.random() < 0.3
        out.append(usage_row(
            message_id=f"m{rng.randrange(keys)}", source=rng.choice("ab"), host_id=rng.choice(("h", "i")), session_id=f"s{rng.randrange(40)}", time_created_utc=START + rng.randrange(70 * DAY), source_time_updated=late + i, agent_raw=rng.choice(("X", "Y")), agent_key="x",
            provider_id=model[0], model_id=model[1], variant=rng.choice((None, "low")), tok_input=rng.randrange(1000), cost=0.25 if paid else None, cost_source="actual" if paid else "unavailable", is_incomplete=rng.random() < 0.1, granularity=rng.choice(("message", "session")),
        ))
    return out


def same(spark, folder, span, unit, **equal):
    held = reports.filtered(archive.archive(spark, folder), span, **equal)
    assert plain(rollup.summary(spark, folder, span, **equal)) == plain(reports.summary(held))
    assert plain(rollup.breakdown(spark, folder, span, True, **equal)) == plain(reports.breakdown(held, True))
    catalog = inputs.catalog(spark)
    assert plain(rollup.trend_costs(spark, folder, catalog, span, unit, **equal)) == plain(reports.trend_costs(held, catalog, span, unit))


def test_rounds_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollup, "MOST_DICTIONARIES", 1)
    folder, rng = str(tmp_path / "archive"), random.Random(11)
    archive.publish(usage(spark, *records(rng, 150, 90)).coalesce(1), folder, 0)
    assert rollup.refresh(spark, folder)["kept"] == 0
    archive.publish(usage(spark, *records(rng, 8, 90, 1000)).coalesce(1), folder, 1)  # these are read as records
    same(spark, folder, LocalRange(date(2024, 1, 5), date(2024, 2, 20), "Asia/Kolkata"), "day", source="a")
    second = rollup.refresh(spark, folder)
    assert second["made"] > 0 and second["kept"] > 0
    assert rollup.refresh(spark, folder) == second
    same(spark, folder, LocalRange(date(2024, 1, 1), date(2024, 4, 1), "America/St_Johns"), "month")
    numbers = spark.read.parquet(*second["dictionaries"])
    assert len(second["dictionaries"]) == 1
    assert sorted(r.number for r in numbers.collect()) == list(range(1, second["sessions"] + 1))
    assert numbers.select("session_id").distinct().count() == second["sessions"]


def test_whole_quarters_read_no_records(spark, tmp_path):
    folder, rng = str(tmp_path / "archive"), random.Random(5)
    archive.publish(usage(spark, *records(rng, 60, 1000)).coalesce(1), folder, 0)
    rollup.refresh(spark, folder)
    for zone in ("UTC", "Asia/Kathmandu"):
        r = rollup.reads(spark, folder, LocalRange(date(2024, 1, 5), date(2024, 2, 20), zone))
        assert r.sums and not r.cut and not r.plain
        opened = rollup.groups(spark, r).inputFiles() + rollup.sessions(spark, r, "source").inputFiles()
        assert opened and not any("/usage/" in f for f in opened)
    # parts of other months and sources stay closed
    january = LocalRange(date(2024, 1, 1), date(2024, 2, 1))
    assert all("month=2024-01" in p for p in rollup.reads(spark, folder, january).sums)
    assert len(rollup.reads(spark, folder, january, ["a"]).sums) < len(rollup.reads(spark, folder, january).sums)


def test_buckets_within_a_quarter(spark, tmp_path):
    """Clocks in Monrovia were 44 minutes and 30 seconds behind until 1972."""
    folder, rng = str(tmp_path / "archive"), random.Random(7)
    old = [r | {"time_created_utc": r["time_created_utc"] - START} for r in records(rng, 60, 1000)]
    archive.publish(usage(spark, *old).coalesce(1), folder, 0)
    rollup.refresh(spark, folder)
    span = LocalRange(date(1970, 1, 3), date(1970, 2, 10), "Africa/Monrovia")
    assert rollup.reads(spark, folder, span).cut
    same(spark, folder, span, "day")


def test_little_or_nothing(spark, tmp_path):
    span = LocalRange(date(2024, 1, 1), date(2024, 2, 1))
    folder = str(tmp_path / "archive")
    assert rollup.refresh(spark, folder) is None
    assert rollup.summary(spark, folder, span).first().sessions == 0
    assert rollup.breakdown(spark, folder, span).count() == 0
    archive.publish(usage(spark, usage_row(time_created_utc=START, is_incomplete=True)), folder, 0)
    assert rollup.refresh(spark, folder)["sessions"] == 0
    got = rollup.summary(spark, folder, span).first()
    assert (got.sessions, got.messages, got.tok_input) == (0, 0, 0)
    # a session that is in two parts and at either end of a quarter counts once
    archive.publish(usage(spark, *(usage_row(message_id=f"n{i}", time_created_utc=START + i * 899_999) for i in range(20))), folder, 1)
    rollup.refresh(spark, folder)
    assert rollup.summary(spark, folder, span).first().sessions == 1
    assert rollup.sessions(spark, rollup.reads(spark, folder, span), "host_id").select(F.sum("sessions")).first()[0] == 1


def test_a_session_of_a_quarter_takes_a_number(spark, tmp_path):
    """Most quarters see few of all sessions: what is kept of each grows with those, not with a bitmap's width."""
    folder = str(tmp_path / "archive")
    rows = [usage_row(message_id=f"m{i}", session_id=f"s{i % 50}", time_created_utc=START + i % 100 * rollup.GRAIN) for i in range(300)]
    archive.publish(usage(spark, *rows).coalesce(1), folder, 0)
    rollup.refresh(spark, folder)
    span = LocalRange(date(2024, 1, 1), date(2024, 2, 1))
    kept = spark.read.parquet(*rollup.reads(spark, folder, span).sessions).collect()
    assert 100 <= len(kept) <= 300  # a record's slot is that of its key
    assert all(len(v) < 100 for r in kept for v in r if isinstance(v, (str, bytearray)))
    assert rollup.summary(spark, folder, span).first().sessions == 50


def test_records_are_summed_up_without_a_sort(spark, tmp_path):
    """A maximum of strings is left for few rows: Spark would sort all records by all keys for it."""
    folder, rng = str(tmp_path / "archive"), random.Random(3)
    archive.publish(usage(spark, *records(rng, 20, 20)).coalesce(1), folder, 0)
    held = rollup._grained(archive.archive(spark, folder))
    assert "SortAggregate" not in rollup._sums(held)._jdf.queryExecution().executedPlan().toString()


def test_prices_meet_buckets_not_quarters(spark, tmp_path, monkeypatch):
    folder, met = str(tmp_path / "archive"), []
    rows = [usage_row(message_id=f"m{i}", time_created_utc=START + i * rollup.GRAIN, cost=0.5 if i % 2 else None, cost_source="actual" if i % 2 else "unavailable") for i in range(96)]
    archive.publish(usage(spark, *rows).coalesce(1), folder, 0)
    rollup.refresh(spark, folder)
    plain_costs = reports.costs_of_groups
    monkeypatch.setattr(reports, "costs_of_groups", lambda groups, *a: met.append(groups) or plain_costs(groups, *a))
    got = rollup.trend_costs(spark, folder, inputs.catalog(spark), LocalRange(date(2024, 1, 1), date(2024, 1, 2)), "day").where("dimension = 'total'").first()
    assert met[0].count() == 2
    assert (got.actual_sum, got.actual_count, got.unavailable_count) == (24.0, 48, 48)
