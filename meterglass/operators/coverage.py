"""Which time windows were really scanned: unions of intervals, and what they say about a report's buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("host_id", "source")


def valid(intervals: DataFrame) -> DataFrame:
    """Intervals that don't end before they start; empty ones are allowed."""
    return intervals.where("interval_start <= interval_end")


def union_intervals(intervals: DataFrame, *keys: str) -> DataFrame:
    """(keys, interval_start, interval_end): touching or overlapping intervals of a key as one."""
    ordered = Window.partitionBy(*keys).orderBy("interval_start", "interval_end")
    reach = F.max("interval_end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("interval_start") <= F.col("reach"), 0).otherwise(1)).over(ordered)
    rows = intervals.withColumn("reach", reach).withColumn("island", island)
    return rows.groupBy(*keys, "island").agg(F.min("interval_start").alias("interval_start"), F.max("interval_end").alias("interval_end")).drop("island")


def extend(intervals: DataFrame, new: DataFrame) -> DataFrame:
    """The live interval of a pair is the hull of what it was and what was asked for."""
    return intervals.unionByName(new).groupBy(*PAIR, "origin").agg(F.min("interval_start").alias("interval_start"), F.max("interval_end").alias("interval_end"))


class CutoffBeforeRecord(ValueError):
    """A cutoff that lies before a record that was seen."""


def extend_to_cutoff(intervals: DataFrame, rounds: DataFrame) -> DataFrame:
    """Intervals after rounds (host_id, source, earliest, cutoff) that say up to when they are complete.

    A pair's live interval keeps its first start, or starts at the earliest record, or at the cutoff where none was
    seen; its end never goes back. Intervals of other origins stay.
    """
    if rounds.where("earliest > cutoff").first():
        raise CutoffBeforeRecord("a round's cutoff lies before its earliest record")
    have = intervals.where("origin = 'live'").groupBy(*PAIR).agg(F.min("interval_start").alias("s"), F.max("interval_end").alias("e"))
    new = rounds.groupBy(*PAIR).agg(F.min(F.coalesce("earliest", "cutoff")).alias("first"), F.max("cutoff").alias("cutoff"))
    both = have.join(new, list(PAIR), "full_outer")
    live = both.select(*PAIR, F.lit("live").alias("origin"), F.coalesce("s", "first").alias("interval_start"), F.greatest("e", "cutoff").alias("interval_end"))
    return intervals.where("origin <> 'live'").select(live.columns).unionByName(live)


def with_holes(usage_files: DataFrame, now_ms: int, window_start: int) -> DataFrame:
    """(host_id, source, interval_start, interval_end, unreadable) of a round over files (host_id, source, readable).

    A pair with an unreadable file has a hole: nothing of the window counts as scanned for it. Others are scanned.
    """
    each = usage_files.groupBy(*PAIR).agg(F.count_if(~F.col("readable")).alias("unreadable"))
    end = F.when(F.col("unreadable") == 0, F.lit(now_ms)).otherwise(F.lit(window_start)).cast("bigint")
    return each.select(*PAIR, F.lit(window_start).cast("bigint").alias("interval_start"), end.alias("interval_end"), "unreadable")


def explained(buckets: DataFrame, intervals: DataFrame, now_ms: int) -> DataFrame:
    """(label, coverage, in_progress, pairs, unknown) of buckets that aren't full: what can be said of each.

    pairs: host/source texts, partly covered ones first; these are left out while the bucket goes on. unknown: nothing
    explains the bucket, and it is over.
    """
    progress = (F.col("bucket_start") <= now_ms) & (now_ms < F.col("bucket_end"))
    said = notes(buckets, intervals, now_ms).select("label", F.concat("partial", "missing").alias("pairs"))
    none = F.array().cast("array<string>")
    rows = status(buckets, intervals).where("coverage <> 'full'").join(said, "label", "left")
    # a bucket whose only shortfalls are those that its going on explains has a note in its own right
    known = F.col("pairs").isNotNull()
    return rows.select("label", "coverage", progress.alias("in_progress"), F.coalesce("pairs", none).alias("pairs"), (~known & ~progress).alias("unknown"))


def replace_origin(intervals: DataFrame, new: DataFrame) -> DataFrame:
    """new in place of all intervals of its (pair, origin)."""
    keys = [*PAIR, "origin"]
    return intervals.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def observed_span(usage: DataFrame) -> DataFrame:
    """[first, last + 1) of the records of each pair."""
    return usage.groupBy(*PAIR).agg(F.min("time_created_utc").alias("interval_start"), (F.max("time_created_utc") + 1).alias("interval_end"))


def per_pair(buckets: DataFrame, intervals: DataFrame) -> DataFrame:
    """(bucket_start, bucket_end, label, pair, covers, meets): each bucket with each pair's intervals.

    Buckets and pairs are few: a report has at most 3,660 days, which are 91,500 hours; they go into one list (of some
    4 MB), and each pair unfolds it, so nothing is joined without a key.
    """
    spans = union_intervals(valid(intervals), *PAIR).groupBy(*PAIR).agg(F.collect_list(F.struct("interval_start", "interval_end")).alias("spans"))
    listed = buckets.agg(F.collect_list(F.struct("bucket_start", "bucket_end", "label")).alias("all")).withColumn("one", F.lit(1))
    rows = spans.withColumn("one", F.lit(1)).join(F.broadcast(listed), "one").select(*PAIR, "spans", F.explode("all").alias("b")).select(*PAIR, "spans", "b.*")
    start, end = F.col("bucket_start"), F.col("bucket_end")
    covers = F.exists("spans", lambda s: (s["interval_start"] <= start) & (s["interval_end"] >= end))
    meets = F.exists("spans", lambda s: (s["interval_start"] < end) & (s["interval_end"] > start))
    return rows.select("bucket_start", "bucket_end", "label", *PAIR, (covers & (start < end)).alias("covers"), (meets & (start < end)).alias("meets"))


def swept(buckets: DataFrame, intervals: DataFrame) -> DataFrame:
    """(bucket_start, covering, meeting, pairs) of the buckets that are not empty, by a sweep over their boundaries.

    Each pair's intervals, united, cover and meet runs of buckets: a run is one more at its first bucket and one less
    after its last, and running sums give the counts. So the cost is that of the intervals and of the buckets (91,500
    at most), not of their product. covering: pairs; meeting: intervals, several of which may be one pair's.
    """
    known = buckets.where("bucket_start < bucket_end").select("bucket_start", "bucket_end").distinct().orderBy("bucket_start").toPandas()  # of bounded size
    starts, ends = known["bucket_start"].to_numpy(), known["bucket_end"].to_numpy()
    spans = union_intervals(valid(intervals), *PAIR).groupBy(*PAIR).agg(F.collect_list("interval_start").alias("s"), F.collect_list("interval_end").alias("e"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, pairs = np.zeros((2, len(starts) + 1), np.int64), 0
        for batch in batches:
            pairs += batch.num_rows
            s, e = (c.flatten().to_numpy() for c in batch.columns)
            first = np.searchsorted(starts, s), np.searchsorted(ends, s, side="right")
            after = np.searchsorted(ends, e, side="right"), np.searchsorted(starts, e)
            for k in (0, 1):
                some = first[k] < after[k]
                np.add.at(change[k], first[k][some], 1)
                np.add.at(change[k], after[k][some], -1)
        at = np.flatnonzero(change.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 0)), pa.array(np.append(change[0, at], 0)), pa.array(np.append(change[1, at], 0)), pa.array(np.append(np.zeros(at.size, np.int64), pairs))], ["i", "covering", "meeting", "pairs"])

    change = spans.select("s", "e").mapInArrow(runs, "i long, covering long, meeting long, pairs long")
    index = buckets.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(starts)], "i long, bucket_start long")
    change = index.join(change.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("covering", "meeting", "pairs"))), "i", "left")
    so_far = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a bucket
    total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c)
    return change.select("bucket_start", total("covering"), total("meeting"), total("pairs"))


def status(buckets: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds coverage to buckets: none, partial or full over all pairs with intervals."""
    said = F.when(F.coalesce("meeting", F.lit(0)) == 0, "none").when(F.col("covering") == F.col("pairs"), "full").otherwise("partial")
    return buckets.join(swept(buckets, intervals), "bucket_start", "left").withColumn("coverage", said).drop("covering", "meeting", "pairs")


def notes(buckets: DataFrame, intervals: DataFrame, now_ms: int) -> DataFrame:
    """(label, in_progress, partial, missing) of buckets that aren't full: pairs as sorted host/source texts.

    In a bucket that now lies in, partly covered pairs are no news and left out.
    """
    pair = F.concat_ws("/", *PAIR)
    progress = (F.col("bucket_start") <= now_ms) & (now_ms < F.col("bucket_end"))
    short = per_pair(buckets, intervals).where("not covers")
    rows = short.groupBy("label", progress.alias("in_progress")).agg(F.array_sort(F.collect_set(F.when(F.col("meets"), pair))).alias("partial"), F.array_sort(F.collect_set(F.when(~F.col("meets"), pair))).alias("missing"))
    rows = rows.withColumn("partial", F.when(F.col("in_progress"), F.array().cast("array<string>")).otherwise(F.col("partial")))
    return rows.where((F.size("partial") > 0) | (F.size("missing") > 0))


def masked(series: DataFrame, *measures: str) -> DataFrame:
    """Measures of uncovered buckets are null, whatever records say; other empty buckets have 0. Last step of a report."""
    seen = F.col("coverage") != "none"
    return series.withColumns({m: F.when(seen, F.coalesce(F.col(m), F.lit(0))) for m in measures})


def selected(intervals: DataFrame, host_id: str | None = None, source: str | None = None) -> DataFrame:
    """Intervals of the pairs that a report asks for; only host and source choose among them."""
    for column, value in (("host_id", host_id), ("source", source)):
        if value is not None:
            intervals = intervals.where(F.col(column) == value)
    return intervals
