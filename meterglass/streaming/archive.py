"""The archive that rounds are merged into: parts of immutable files, an index of keys, and one line that says what is in force.

Parts are dealt by source, UTC month of creation, and slot of the key's hash. Each key's hash is listed with every month
that it has been put into, dealt by the same slots. So a round finds the record that an arrival replaces in whatever
month it lies; it reads and rewrites only slots of months that hold an arrival or the record that it moves.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, merge, reports
from ..schema import KEY, USAGE, checked

POINTER = "current"
#: Slots that the keys of a month are dealt to; rounds whose lines lie in one folder; key lists that are read before
#: they are put together.
SLOTS, ERA, MOST_KEY_LISTS = 8, 64, 16
CURSORS = "host_id string, source string, cursor bigint"
INTERVALS = "host_id string, source string, origin string, interval_start bigint, interval_end bigint"
PARTS = "source string, month string, slot int, path string, first bigint, last bigint, n bigint"
KEYS = "source string, h bigint, month string, slot int"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-archive-")


def _lines(spark: SparkSession, folder: str, era: int, pointer: str = POINTER) -> list[dict]:
    """The lines of an era's rounds, in order; none if there is no such era."""
    try:
        rows = spark.read.text(f"{folder}/{pointer}/era={era}").collect()  # ERA lines at most
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted((json.loads(r[0]) for r in rows if r[0]), key=lambda m: m["number"])


def manifest(spark: SparkSession, folder: str, as_of: int | None = None, pointer: str = POINTER) -> dict | None:
    """The state in force, or the one that was after round `as_of`; pointer: which lines tell it.

    Eras follow each other without a gap, so the last is found by doubling and halving; what is read doesn't grow with
    the number of rounds.
    """
    found = {}

    def lines(era: int) -> list[dict]:
        if era not in found:
            found[era] = _lines(spark, folder, era, pointer)
        return found[era]

    fits = lambda era: bool(lines(era)) and (as_of is None or lines(era)[0]["round"] <= as_of)
    if not fits(0):
        return None
    low, high = 0, 1
    while fits(high):
        low, high = high, high * 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return [m for m in lines(low) if as_of is None or m["round"] <= as_of][-1]


def month() -> Column:
    return F.date_format(F.timestamp_millis("time_created_utc"), "yyyy-MM")


def key_hash() -> Column:
    return F.xxhash64(*KEY)


def _table(spark: SparkSession, path: str | list[str] | None, schema: str) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def usage(spark: SparkSession, paths: list[str]) -> DataFrame:
    return checked(spark.read.schema(USAGE).parquet(*paths)) if paths else spark.createDataFrame([], USAGE)


def parts(spark: SparkSession, folder: str, as_of: int | None = None) -> DataFrame:
    """(source, month, slot, path, first, last, n) of the parts in force: what a planner of reads needs to know."""
    m = manifest(spark, folder, as_of)
    return _table(spark, m["parts"] if m else None, PARTS)


def archive(spark: SparkSession, folder: str, start_ms: int | None = None, end_ms: int | None = None, sources: list[str] | None = None, as_of: int | None = None) -> DataFrame | None:
    """Records of the archive as last published, or as of a round: those created in [start, end) and of the sources.

    Parts that can hold none of these are not opened.
    """
    m = manifest(spark, folder, as_of)
    if m is None:
        return None
    chosen, wanted = _table(spark, m["parts"], PARTS), F.lit(True)
    if start_ms is not None:
        chosen, wanted = chosen.where(F.col("last") >= start_ms), wanted & (F.col("time_created_utc") >= start_ms)
    if end_ms is not None:
        chosen, wanted = chosen.where(F.col("first") < end_ms), wanted & (F.col("time_created_utc") < end_ms)
    if sources is not None:
        chosen = chosen.where(F.col("source").isin(sources))
    return usage(spark, [r["path"] for r in chosen.select("path").collect()]).where(wanted)


def reaching(have: list, after_ms: int | None, limit: int) -> tuple[list[str], int | None]:
    """(paths, low): parts (PARTS) with the `limit` newest records up to a time, none of which is older than low.

    Parts that lie wholly before the time are counted from the newest on until they hold enough; low is None where all
    parts are needed. Parts that reach beyond the time may have few records before it, so they are read but not counted.
    """
    rows = [p for p in have if after_ms is None or p["first"] <= after_ms]
    low, counted = None, 0
    for p in sorted((p for p in rows if after_ms is None or p["last"] < after_ms), key=lambda p: -p["first"]):
        counted += p["n"]
        if counted >= limit:
            low = p["first"]
            break
    return [p["path"] for p in rows if low is None or p["last"] >= low], low


def page(spark: SparkSession, folder: str, limit: int, after: tuple[int, str, str, str] | None = None, sources: list[str] | None = None, where: Column | None = None, as_of: int | None = None) -> DataFrame:
    """`reports.detail_after` of the archive: a page costs the same wherever it lies, as only parts that can have its records are opened.

    With `where`, more parts are opened, four times the records each time, until the page is full. as_of: the round whose
    archive is paged through, so that pages of one reader agree while rounds go on.
    """
    m, limit = manifest(spark, folder, as_of), min(limit, reports.MOST_PER_PAGE)
    wanted = limit
    have = _table(spark, m["parts"] if m else None, PARTS).collect()  # one row a part
    have = [p for p in have if sources is None or p["source"] in sources]
    while True:
        paths, low = reaching(have, after[0] if after else None, wanted)
        rows = usage(spark, paths)
        for said in (F.col("time_created_utc") >= low if low is not None else None, where):
            rows = rows if said is None else rows.where(said)
        rows = reports.detail_after(rows, limit, after)
        if where is None or low is None:
            return rows
        full = rows.collect()  # a page
        if len(full) == limit:
            return spark.createDataFrame(full, USAGE)
        wanted *= 4


def cursors(spark: SparkSession, folder: str) -> DataFrame:
    """(host_id, source, cursor) as last published."""
    m = manifest(spark, folder)
    return _table(spark, m["cursors"] if m else None, CURSORS)


def covered(spark: SparkSession, folder: str) -> DataFrame:
    """(host_id, source, origin, interval_start, interval_end) as last published."""
    m = manifest(spark, folder)
    return _table(spark, m["coverage"] if m else None, INTERVALS)


def out_of_force(spark: SparkSession, folder: str, keep: int) -> DataFrame:
    """(path) of parts that were written but are not in force now, nor were after round `keep`: these may be deleted.

    All parts lie in folders that their rounds' lines name, so nothing is listed but the lines.
    """
    held = parts(spark, folder).select("path").union(parts(spark, folder, keep).select("path"))
    told, era = [], 0
    while lines := _lines(spark, folder, era):
        told += [m["parts"] for m in lines if keep < m["round"]] + [m["parts"] for m in lines if m["round"] <= keep]
        era += 1
    return _table(spark, told, PARTS).select("path").distinct().join(held, "path", "left_anti")


def _looked_up(good: DataFrame, before: dict | None, slots: list[int], path: str) -> DataFrame:
    """(source, h, slot, month, known): each arrival's key and month with a month that the key has been put into, if any.

    Two keys of one hash only name months for each other that need not be read.
    """
    spark = good.sparkSession
    known = _table(spark, before["keys"] if before else None, KEYS).where(F.col("slot").isin(slots)).select("source", "h", F.col("month").alias("known"))
    keys = good.select("source", "h", "slot", "month").distinct()
    keys.join(known, ["source", "h"], "left").write.mode("overwrite").parquet(f"{path}/looked_up")
    return spark.read.parquet(f"{path}/looked_up")


def publish(arrivals: DataFrame, folder: str, round_id: int, window: DataFrame | None = None, strict: bool = True) -> dict:
    """One round: arrivals (the fact and arrival_seq) into new parts of the archive, then one line that makes them current.

    window: the intervals (as INTERVALS) that were asked for, with or without records in them. A bad record rejects the
    round; if not strict, it goes to the folder's quarantine. A round that was published before is left alone, so a
    restarted stream may offer it again. A failure before the last write leaves all in force as it was. A record replaces
    the one of its key wherever that lies. The arrivals are computed once, and written before anything is decided. The
    line that is returned says what happened: rows changed and rejected, parts rewritten and parts that were read.
    """
    spark = arrivals.sparkSession
    before = manifest(spark, folder)
    if before and before["round"] >= round_id:
        return before
    path = f"{folder}/round={round_id}"
    names = [f.name for f in USAGE]
    if "arrival_seq" not in arrivals.columns:
        arrivals = arrivals.withColumn("arrival_seq", F.lit(round_id).cast("bigint"))
    arrivals = arrivals.select(*(F.col(f.name).cast(f.dataType) for f in USAGE), F.col("arrival_seq").cast("bigint"))
    arrivals = arrivals.withColumns({"violation": merge.violation(), "h": key_hash(), "month": month()}).withColumn("slot", F.pmod("h", F.lit(SLOTS)).cast("int"))
    arrivals.write.mode("overwrite").parquet(f"{path}/arrivals")
    staged = spark.read.schema(arrivals.schema).parquet(f"{path}/arrivals")
    # one look at a few columns: which parts arrivals belong to, and what is wrong
    stats = staged.groupBy("source", "month", "slot").agg(F.count_if(F.col("violation").isNull()).alias("good"), F.count_if(F.col("violation").isNotNull()).alias("bad"), F.min(F.when(F.col("violation").isNotNull(), F.struct("violation", *KEY))).alias("worst")).collect()
    rejected = sum(r["bad"] for r in stats)
    if strict and rejected:
        worst = min((r["worst"] for r in stats if r["worst"]), key=lambda w: tuple(str(x) for x in w))
        raise merge.RejectedRound(f"{worst['violation']}: {worst['host_id']}/{worst['source']}/{worst['message_id']}")
    if not strict:
        staged.where("violation is not null").select(*names, "arrival_seq", "violation").write.mode("overwrite").parquet(f"{folder}/quarantine/round={round_id}")
    good = staged.where("violation is null")
    have = _table(spark, before["parts"] if before else None, PARTS).collect()  # one row a part
    touched = {(r["source"], r["month"], r["slot"]) for r in stats if r["good"]}
    looked = _looked_up(good, before, sorted({s for *_, s in touched}), path)
    elsewhere = looked.where("known <> month").select("source", F.col("known").alias("month"), "slot").distinct().collect()  # parts, not keys
    near = {tuple(r) for r in elsewhere} - touched
    beside = [p["path"] for p in have if (p["source"], p["month"], p["slot"]) in near]
    if beside:  # a key may have left a month that it is listed with, which is told by the key columns alone
        moved = usage(spark, beside).select(*KEY, month().alias("month"), F.pmod(key_hash(), F.lit(SLOTS)).cast("int").alias("slot")).join(good.select(*KEY).distinct(), list(KEY), "left_semi")
        touched |= {tuple(r) for r in moved.select("source", "month", "slot").distinct().collect()}
    replaced = [p for p in have if (p["source"], p["month"], p["slot"]) in touched]
    old = usage(spark, [p["path"] for p in replaced]).withColumn("arrival_seq", F.lit(-1).cast("bigint"))
    rows = merge.winners(old.unionByName(good.select(*names, "arrival_seq")), *KEY)
    rows = rows.select(*names, (F.col("arrival_seq") >= 0).alias("arrived"), month().alias("month"), F.pmod(key_hash(), F.lit(SLOTS)).cast("int").alias("slot"), F.substring(F.sha2("source", 256), 1, 12).alias("of"))
    # a part's rows go to several tasks, as one source may have most of a month
    rows.repartition("of", "month", "slot", F.pmod(F.xxhash64("message_id"), F.lit(8))).write.mode("overwrite").partitionBy("of", "month", "slot").parquet(f"{path}/usage")
    written, changed = [], 0
    if touched:
        dealt = spark.read.schema("source string, time_created_utc bigint, arrived boolean, of string, month string, slot int").parquet(f"{path}/usage")
        dealt = dealt.groupBy("source", "of", "month", "slot").agg(F.count_if("arrived").alias("changed"), F.min("time_created_utc").alias("first"), F.max("time_created_utc").alias("last"), F.count("*").alias("n"))
        for r in dealt.collect():  # one row a part
            written.append((r["source"], r["month"], r["slot"], f"{path}/usage/of={r['of']}/month={r['month']}/slot={r['slot']}", r["first"], r["last"], r["n"]))
            changed += r["changed"]
    spark.createDataFrame([*(tuple(p) for p in have if p not in replaced), *written], PARTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    # from what was written: nothing is merged again
    fresh = merge.cursors(usage(spark, [w[3] for w in written]))
    known = _table(spark, before["cursors"] if before else None, CURSORS)
    known.unionByName(fresh).groupBy("host_id", "source").agg(F.max("cursor").alias("cursor")).write.mode("overwrite").parquet(f"{path}/cursors")
    line = {
        "number": before["number"] + 1 if before else 0, "round": round_id, "parts": f"{path}/parts", "keys": _listed(looked, before, path), "cursors": f"{path}/cursors", "coverage": before["coverage"] if before else None,
        "changed": changed, "rejected": rejected, "rewritten": len(written), "parts_read": len(replaced), "keys_read": len(beside),
    }
    if window is not None:
        coverage.extend(_table(spark, before["coverage"] if before else None, INTERVALS), window).write.mode("overwrite").parquet(f"{path}/coverage")
        line["coverage"] = f"{path}/coverage"
    spark.createDataFrame([(json.dumps(line),)], "value string").coalesce(1).write.mode("append").text(f"{folder}/{POINTER}/era={line['number'] // ERA}")
    return line


def _listed(looked: DataFrame, before: dict | None, path: str) -> list[str]:
    """The key lists after a round: what is new is a list of its own; many lists are put together into one."""
    spark = looked.sparkSession
    new = looked.groupBy("source", "h", "slot", "month").agg(F.coalesce(F.bool_or(F.col("known") == F.col("month")), F.lit(False)).alias("listed")).where("not listed")
    rows, lists, name = new.select("source", "h", "month", "slot"), before["keys"] if before else [], "keys"
    if len(lists) >= MOST_KEY_LISTS:
        rows, lists, name = _table(spark, lists, KEYS).unionByName(rows).distinct(), [], "all_keys"
    # sorted, so that a small round skips most of a list by its statistics
    rows.repartition("slot", F.col("h") % 64).sortWithinPartitions("slot", "h").write.mode("overwrite").parquet(f"{path}/{name}")
    return [*lists, f"{path}/{name}"]
