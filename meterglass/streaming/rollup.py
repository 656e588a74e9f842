"""Aggregates kept beside the archive's parts: sums by quarter of an hour, and which sessions each of them had.

A part never changes once it is written, so its aggregate is made once, and made anew only for parts that a round has
rewritten. Reports read aggregates for the quarters that lie wholly in their range and records for what is cut at its
ends; parts that have no aggregate yet are read as records. So a report is right whenever it is asked, and only faster
after `refresh`. Sessions are exact: each has a number in a dictionary, and distinct numbers are counted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import pricing, reports
from ..schema import TOKENS
from .archive import ERA, PARTS, SLOTS, _table, key_hash, manifest, month, usage

#: Not that of folders whose aggregates had bitmaps: these are made anew.
POINTER = "rolled_numbers"
#: Milliseconds of a quarter of an hour: local days and hours of today's time zones all begin with one.
GRAIN = 900_000
MOST_DICTIONARIES = 16
BY = ("host_id", "source", "agent_key", "variant", "provider_id", "model_id")
HELD = "path string, sums string, sessions string"
NUMBERS = "session_id string, number bigint"
SUMS = (
    "grain bigint, host_id string, source string, agent_key string, variant string, provider_id string, model_id string, cost_source string, "
    f"records bigint, {', '.join(f'{t} bigint' for t in TOKENS)}, cost double, messages bigint, session_records bigint, label string"
)
SESSIONS = "grain bigint, host_id string, source string, agent_key string, variant string, provider_id string, model_id string, number bigint"


def _grained(records: DataFrame) -> DataFrame:
    return records.where("not is_incomplete").withColumn("grain", F.floor(F.col("time_created_utc") / GRAIN) * GRAIN)


def _sums(records: DataFrame, *more: str) -> DataFrame:
    """Complete records (with grain) summed up by all that reports group by and all that decides a price."""
    counts = [F.count_if(F.col("granularity") == g).alias(c) for g, c in (("message", "messages"), ("session", "session_records"))]
    # by label too, as its maximum would make Spark sort all records before it sums them up
    return pricing.folded(records.withColumnRenamed("agent_raw", "label"), *more, "grain", "host_id", "source", "agent_key", "variant", "label", extra=counts)


def _numbered(sessions: DataFrame, known: DataFrame, so_far: int, path: str) -> int:
    """Writes (session_id, number) of sessions (session_id, first) that aren't known; how many sessions have a number then.

    Numbers go up in order of first use, so those of an hour are near each other. They are dealt range by range without
    a gap: only the number of rows of each range passes the driver.
    """
    spark = sessions.sparkSession
    new = sessions.join(known, "session_id", "left_anti").repartitionByRange("first", "session_id").sortWithinPartitions("first", "session_id")
    at = F.monotonically_increasing_id()
    new.select("session_id", F.shiftright(at, 33).alias("range"), at.bitwiseAND((1 << 33) - 1).alias("nth")).write.mode("overwrite").parquet(f"{path}/ranged")
    ranged = spark.read.schema("session_id string, range bigint, nth bigint").parquet(f"{path}/ranged")
    offsets, total = [], so_far
    for r in sorted(ranged.groupBy("range").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["range"], total + 1))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(offsets, "range bigint, start bigint"))  # one row a task of the write
    ranged.join(starts, "range").select("session_id", (F.col("start") + F.col("nth")).alias("number")).write.mode("overwrite").parquet(f"{path}/numbers")
    return total


def refresh(spark: SparkSession, folder: str) -> dict | None:
    """Makes aggregates for the parts in force that have none, then one line that makes them current; that line.

    It says how many parts were aggregated and how many kept theirs. A failure before the last write changes nothing.
    """
    now, before = manifest(spark, folder), manifest(spark, folder, pointer=POINTER)
    if now is None or before and before["round"] >= now["round"]:
        return before
    path = f"{folder}/{POINTER}_of/round={now['round']}"
    inside = {p["path"]: "/".join(p["path"].split("/")[-3:]) for p in _table(spark, now["parts"], PARTS).collect()}  # one row a part
    held = [tuple(r) for r in _table(spark, before["held"] if before else None, HELD).collect() if r["path"] in inside]
    todo = sorted(set(inside) - {h[0] for h in held})
    dictionaries, total = (before["dictionaries"], before["sessions"]) if before else ([], 0)
    if todo:
        dealt = {"of": F.substring(F.sha2("source", 256), 1, 12), "month": month(), "slot": F.pmod(key_hash(), F.lit(SLOTS)).cast("int")}
        records = _grained(usage(spark, todo)).withColumns(dealt)
        known = _table(spark, dictionaries, NUMBERS)
        total = _numbered(records.groupBy("session_id").agg(F.min("time_created_utc").alias("first")), known.select("session_id"), total, path)
        dictionaries = [*dictionaries, f"{path}/numbers"]
        if len(dictionaries) > MOST_DICTIONARIES:
            _table(spark, dictionaries, NUMBERS).repartition("session_id").write.mode("overwrite").parquet(f"{path}/all_numbers")
            dictionaries = [f"{path}/all_numbers"]
        # a hot session is a few rows a quarter before it meets the dictionary
        pairs = records.select(*dealt, "grain", *BY, "session_id").distinct().join(_table(spark, dictionaries, NUMBERS), "session_id")
        spread = (*dealt, F.pmod(F.xxhash64("grain"), F.lit(8)))
        # a quarter has few records of most sessions, so a row for each of its sessions is less than a bitmap of all
        for name, rows in (("sums", _sums(records, *dealt)), ("sessions", pairs.drop("session_id"))):
            rows.repartition(*spread).sortWithinPartitions(*dealt, "grain").write.mode("overwrite").partitionBy(*dealt).parquet(f"{path}/{name}")
        some = _aggregated(spark, path, {p: inside[p] for p in todo})
        held += [(p, *(f"{path}/{name}/{inside[p]}" if p in some else None for name in ("sums", "sessions"))) for p in todo]
    spark.createDataFrame(held, HELD).coalesce(1).write.mode("overwrite").parquet(f"{path}/held")
    line = {"number": before["number"] + 1 if before else 0, "round": now["round"], "held": f"{path}/held", "dictionaries": dictionaries, "sessions": total, "made": len(todo), "kept": len(held) - len(todo)}
    spark.createDataFrame([(json.dumps(line),)], "value string").coalesce(1).write.mode("append").text(f"{folder}/{POINTER}/era={line['number'] // ERA}")
    return line


def _aggregated(spark: SparkSession, path: str, inside: dict[str, str]) -> set[str]:
    """Those of the parts that have complete records, so that there is an aggregate."""
    rows = spark.read.schema("of string, month string, slot int").parquet(f"{path}/sums").distinct().collect()  # one row a part
    there = {f"of={r['of']}/month={r['month']}/slot={r['slot']}" for r in rows}
    return {p for p, tail in inside.items() if tail in there}


@dataclass(frozen=True)
class Reads:
    """What a report over [start, end) opens: aggregates for [low, high), and records of `cut` parts outside of it and of `plain` ones."""

    start: int
    low: int
    high: int
    end: int
    sums: tuple[str, ...]
    sessions: tuple[str, ...]
    cut: tuple[str, ...]
    plain: tuple[str, ...]
    dictionaries: tuple[str, ...]


def reads(spark: SparkSession, folder: str, span: C.LocalRange, sources: list[str] | None = None) -> Reads:
    """The plan of a range: parts that can hold nothing of it are in none of the lists."""
    start, end = spark.range(1).select(*(C.day_start(F.lit(d), span.zone) for d in (span.start, span.end))).first()
    low, high = -(-start // GRAIN) * GRAIN, end // GRAIN * GRAIN
    now, rolled = manifest(spark, folder), manifest(spark, folder, pointer=POINTER)
    parts = _table(spark, now["parts"] if now else None, PARTS).where((F.col("last") >= start) & (F.col("first") < end))
    if sources is not None:
        parts = parts.where(F.col("source").isin(sources))
    held = {r["path"]: r for r in _table(spark, rolled["held"] if rolled else None, HELD).collect()}  # one row a part
    sums, sessions, cut, plain = [], [], [], []
    for p in parts.collect():
        if p["path"] not in held:
            plain.append(p["path"])
            continue
        if held[p["path"]]["sums"] is None:  # incomplete records only
            continue
        if p["last"] >= low and p["first"] < high:
            sums.append(held[p["path"]]["sums"])
            sessions.append(held[p["path"]]["sessions"])
        if start < low and p["first"] < low or high < end and p["last"] >= high:
            cut.append(p["path"])
    return Reads(start, low, high, end, *(tuple(x) for x in (sums, sessions, cut, plain)), tuple(rolled["dictionaries"] if rolled else ()))


def _outside(spark: SparkSession, r: Reads, **equal: str | None) -> DataFrame:
    """Complete records that the aggregates don't stand for."""
    t = F.col("time_created_utc")
    ends = usage(spark, list(r.cut)).where(((t >= r.start) & (t < r.low)) | ((t >= r.high) & (t < r.end)))
    rows = ends.unionByName(usage(spark, list(r.plain)).where((t >= r.start) & (t < r.end)))
    return _grained(reports.filtered(rows, **equal))


def groups(spark: SparkSession, r: Reads, **equal: str | None) -> DataFrame:
    """The range as rows of SUMS: what was aggregated, and what is left summed up likewise."""
    whole = _table(spark, list(r.sums), SUMS).where((F.col("grain") >= r.low) & (F.col("grain") < r.high))
    names = [c.split()[0] for c in SUMS.split(", ")]
    return reports.filtered(whole, complete=None, **equal).unionByName(_sums(_outside(spark, r, **equal)).select(*names))


def sessions(spark: SparkSession, r: Reads, *keys: str, **equal: str | None) -> DataFrame:
    """(keys, sessions): how many distinct sessions the range has, by keys that are in BY.

    Sessions of records join in by their numbers; those that have none yet are in no aggregate.
    """
    whole = _table(spark, list(r.sessions), SESSIONS).where((F.col("grain") >= r.low) & (F.col("grain") < r.high))
    known = reports.filtered(whole, complete=None, **equal).select(*keys, "number")
    counted = []
    if r.cut or r.plain:
        left = _outside(spark, r, **equal).where("session_id is not null").select(*keys, "session_id").distinct().join(_table(spark, list(r.dictionaries), NUMBERS), "session_id", "left")
        known = known.unionByName(left.where("number is not null").select(*keys, "number"))
        counted = [left.where("number is null").groupBy(*keys).agg(F.count("*").alias("sessions"))]
    rows = known.distinct().groupBy(*keys).agg(F.count("*").alias("sessions"))
    for more in counted:
        rows = rows.unionByName(more)
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"))


def _measured(sums: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """Sums and session counts of the same keys side by side, without a join: keys may be null."""
    added = (*TOKENS, "messages", "session_records")
    rows = sums.select(*keys, *added, "label", F.lit(0).cast("bigint").alias("sessions"))
    rows = rows.unionByName(counts.select(*keys, *(F.lit(0).cast("bigint").alias(c) for c in added), F.lit(None).cast("string").alias("label"), "sessions"))
    # the maximum of labels is left for the few rows of these groups: with a string's maximum, Spark sorts what it groups
    rows = rows.groupBy(*keys, "label").agg(*(F.sum(c).alias(c) for c in (*added, "sessions")))
    return rows.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*added, "sessions")), F.max("label").alias("agent_label"))


def _source(equal: dict[str, str | None]) -> list[str] | None:
    return [equal["source"]] if equal.get("source") is not None else None


def summary(spark: SparkSession, folder: str, span: C.LocalRange, **equal: str | None) -> DataFrame:
    """`reports.summary` of the archive's complete records in the range that are equal in the named columns (of BY)."""
    r = reads(spark, folder, span, _source(equal))
    return _measured(groups(spark, r, **equal), sessions(spark, r, **equal)).drop("agent_label")


def breakdown(spark: SparkSession, folder: str, span: C.LocalRange, by_variant: bool = False, **equal: str | None) -> DataFrame:
    """`reports.breakdown` of the same."""
    r, keys = reads(spark, folder, span, _source(equal)), ["source", "agent_key", "provider_id", "model_id", *(["variant"] if by_variant else [])]
    rows = _measured(groups(spark, r, **equal), sessions(spark, r, *keys, **equal), *keys)
    return rows if by_variant else rows.withColumn("variant", F.lit(None).cast("string"))


def trend_costs(spark: SparkSession, folder: str, catalog: DataFrame, span: C.LocalRange, unit: str, overrides: DataFrame | None = None, **equal: str | None) -> DataFrame:
    """`reports.trend_costs` of the same. Where a bucket begins within a quarter of an hour, all is read as records."""
    r, start = reads(spark, folder, span, _source(equal)), C.bucket_start(F.col("grain"), unit, span)
    if not C.spine(spark, span, unit).where(F.pmod("bucket_start", F.lit(GRAIN)) != 0).isEmpty():
        held = {h["sums"]: h["path"] for h in _table(spark, (manifest(spark, folder, pointer=POINTER) or {}).get("held"), HELD).collect()}
        r = replace(r, sums=(), sessions=(), cut=(), plain=tuple({*r.plain, *r.cut, *(held[s] for s in r.sums)}))
        rows = _sums(_outside(spark, r, **equal).withColumn("grain", F.col("time_created_utc")))
    else:
        rows = groups(spark, r, **equal)
    # quarters are summed up to buckets before prices meet them
    counts = [F.sum(c).alias(c) for c in ("messages", "session_records")]
    rows = pricing.folded(rows.withColumn("bucket_start", start), "bucket_start", "source", "agent_key", "label", extra=counts, records=F.col("records"))
    return reports.costs_of_groups(rows, catalog, overrides)
