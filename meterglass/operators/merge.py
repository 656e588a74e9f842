"""Incremental maintenance: winners among arrivals, cursors, carried state, and differences between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, ORIGINS, TOKENS


class RejectedRound(ValueError):
    """A round with a record that breaks a rule."""


def winners(arrivals: DataFrame, *keys: str) -> DataFrame:
    """The row that stays of each key: more trusted origin, then later update, then later arrival.

    Taking arrivals one by one and replacing a row by another that is no worse gives the same, in any grouping, so
    this is a plain aggregation with partial results.
    """
    rest = [c for c in arrivals.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("origin_priority", "source_time_updated", "arrival_seq"))
    return arrivals.groupBy(*keys).agg(best.alias("w")).select(*keys, *(f"w.{c}" for c in rest))


def merge(archive: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The archive after a round; nothing is ever dropped. Records of the archive count as having come first."""
    old = archive.withColumn("arrival_seq", F.lit(-1).cast("bigint"))
    return winners(old.unionByName(arrivals), *KEY).select(archive.columns)


def changed(arrivals: DataFrame, *keys: str) -> DataFrame:
    """Adds changed: whether an arrival is no worse than all before it and so replaces what is there."""
    before = Window.partitionBy(*keys).orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.struct("origin_priority", "source_time_updated")
    return arrivals.withColumn("changed", F.coalesce(mark >= F.max(mark).over(before), F.lit(True)))


def cursors(usage: DataFrame) -> DataFrame:
    """(host_id, source, cursor): how far live scanning has come."""
    return usage.where("origin = 'live'").groupBy("host_id", "source").agg(F.max("source_time_updated").alias("cursor"))


def within_overlap(rows: DataFrame, watermark: int | None, updated: str = "time_updated", overlap_ms: int = 86_400_000) -> DataFrame:
    """Rows that a round reads: a day before the watermark on, all without one. The filter reaches the scan."""
    return rows if watermark is None else rows.where(F.col(updated) >= max(watermark - overlap_ms, -(1 << 63)))


def deltas(rows: DataFrame, keys: list[str], order: str, total: str, last: str | None = None) -> DataFrame:
    """Adds delta and regressed: what a counter that only grows has gained since the row before.

    A counter that falls gives 0 and is marked. Where it has risen, a gain that the source itself states counts.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    previous = F.coalesce(F.lag(total).over(w), F.lit(0).cast("bigint"))
    gain = F.greatest(F.col(total) - previous, F.lit(0).cast("bigint"))
    stated = F.when((F.col(total) > previous) & (F.col(last) > 0), F.col(last)).otherwise(gain) if last else gain
    return rows.withColumns({"delta": stated, "regressed": F.col(total) < previous})


def carried(rows: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """The columns with nulls replaced by the last value before in the same key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def merged_values(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """Key-wise merge: a new value replaces the old one, absent keys and null values leave it."""
    o = old.select(key, *(F.col(c).alias(f"o_{c}") for c in columns))
    n = new.select(key, *(F.col(c).alias(f"n_{c}") for c in columns))
    return o.join(n, key, "full_outer").select(key, *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in columns))


def missing(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys of left that right doesn't have."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def reconciled(archive: DataFrame, baseline: DataFrame, *keys: str) -> DataFrame:
    """One row that says whether an archive holds what a baseline lists: rows, distinct keys, and keys that one side lacks."""
    sides = archive.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(baseline.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    each = sides.groupBy(*keys).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    counts = each.agg(zero(F.sum("a")).alias("archived"), zero(F.sum("b")).alias("listed"), F.count_if(F.col("a") > 0).alias("archived_keys"), F.count_if(F.col("b") > 0).alias("listed_keys"), F.count_if((F.col("b") > 0) & (F.col("a") == 0)).alias("missing"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("unlisted"))
    return counts.withColumn("equal", (F.col("missing") == 0) & (F.col("unlisted") == 0) & (F.col("archived") == F.col("archived_keys")))


def violation() -> Column:
    """What is wrong with a record, null for nothing; the first rule that it breaks."""
    priority = F.create_map(*(F.lit(v) for pair in ORIGINS.items() for v in pair))
    out = F.when(F.coalesce(F.trim("message_id"), F.lit("")) == "", "blank message id")
    out = out.when(F.col("host_id").isNull() | F.col("source").isNull(), "no host or source")
    out = out.when(~F.coalesce(F.element_at(priority, F.col("origin")) == F.col("origin_priority"), F.lit(False)), "priority doesn't fit the origin")
    out = out.when(F.isnan("cost") | (F.abs("cost") == float("inf")), "cost is not finite")
    for c in TOKENS:
        out = out.when(F.col(c).isNull() | (F.col(c) < 0), f"{c} is negative or missing")
    return out.when(~F.coalesce(F.col("cost_source").isin("actual", "estimated", "unavailable"), F.lit(False)), "unknown cost source").when(~F.coalesce(F.col("granularity").isin("message", "session"), F.lit(False)), "unknown granularity")


def validated(round_: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their violation. Strict: one bad row rejects the round."""
    marked = round_.withColumn("violation", violation())
    bad = marked.where("violation is not null")
    if strict and (first := bad.select(*KEY, "violation").first()):
        raise RejectedRound(f"{first['violation']}: {first['host_id']}/{first['source']}/{first['message_id']}")
    return marked.where("violation is null").drop("violation"), bad
