"""Continuous ingest with Structured Streaming: winners into the archive, and records of files that are still written."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import calendar as C
from ..functions import exprs
from ..operators import coverage, reports
from ..sources import adapters, lines, rollouts
from .archive import INTERVALS, archive, covered, cursors, manifest, publish

__all__ = ["archive", "covered", "cursors", "ingest_round", "publish", "requested", "running_trend", "stream", "stream_deltas", "stream_rollouts"]

def requested(spark: SparkSession, folder: str, pairs: DataFrame, now_ms: int) -> DataFrame:
    """The windows that a round asks pairs (host_id, source) for: from each one's cursor on, up to now."""
    rows = pairs.select("host_id", "source").distinct().join(cursors(spark, folder), ["host_id", "source"], "left")
    start = F.greatest(F.coalesce("cursor", F.lit(0)), F.lit(0)).cast("bigint")
    return rows.select("host_id", "source", F.lit("live").alias("origin"), start.alias("interval_start"), F.lit(now_ms).cast("bigint").alias("interval_end"))


def stream(source: DataFrame, folder: str, checkpoint: str, pairs: DataFrame | None = None, now: Callable[[], int] | None = None, strict: bool = False, told: Callable[[dict], None] | None = None, **trigger):
    """Starts a query that publishes each micro-batch of fact rows (with arrival_seq) as a round.

    pairs and now: what each round asks for, so that windows without records count as scanned too. Bad records are put
    in quarantine, or stop the stream if strict. told: called with the manifest of each round that changed rows.
    Late rows need no rule: a row that is no better than what is held changes nothing, however often it is read.
    """

    def publish_round(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        window = requested(spark, folder, pairs, now()) if pairs is not None and now is not None else None
        known = manifest(spark, folder)
        m = publish(rows, folder, n, window, strict)
        if told is not None and m["changed"] and (known is None or known["round"] < n):
            told(m)

    return source.writeStream.foreachBatch(publish_round).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_round(spark: SparkSession, folder: str, round_id: int, host_id: str, exports: dict[str, tuple[str, ...]], now_ms: int, strict: bool = False) -> dict:
    """One round over a host's exports, by kind the paths of each: scanned, adapted, and published with what was scanned.

    Exports are read whole, so all time up to now counts as scanned for their sources. A file that can't be read is a
    hole: what else there is goes into the archive, but nothing counts as scanned for its source in this round. If strict,
    such a file rejects the round, and so does a bad record; else bad records are put in quarantine. The line that is
    returned has how many files were unreadable, and what was skipped by source and reason. A round that was published
    before is left alone.
    """
    known = manifest(spark, folder)
    if known and known["round"] >= round_id:
        return known
    parts = [adapters.scanned(spark, kind, host_id, f"{folder}/round={round_id}/scanned/{kind}", *paths, strict=strict) for kind, paths in exports.items()]
    facts, skips, files = (reduce(DataFrame.unionByName, column) for column in zip(*parts, strict=True))
    holes = coverage.with_holes(files, now_ms, 0).collect()  # one row a source
    window = spark.createDataFrame([(h["host_id"], h["source"], "live", 0, now_ms) for h in holes if not h["unreadable"]], INTERVALS)
    counts = {f"{r['source']}/{r['skip_reason']}": r["n"] for r in skips.groupBy("source", "skip_reason").agg(F.sum("n").alias("n")).collect()}  # few reasons
    line = publish(facts, folder, round_id, window, strict)
    return line | {"unreadable": sum(h["unreadable"] for h in holes), "skipped": counts}


def running_trend(usage: DataFrame, span: C.LocalRange, unit: str) -> DataFrame:
    """The trend of a stream of fact rows: each row has its calendar bucket itself, whatever the zone's offset."""
    return reports.trend(reports.filtered(usage, span), span, unit)


class Deltas(StatefulProcessor):
    """Keeps the last total of each key and emits gains, lines in order within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("line", ignore_index=True)
        before = self.total.get()[0] if self.total.exists() else 0
        previous = batch["total"].shift(fill_value=before)
        self.total.update((int(batch["total"].iloc[-1]),))
        yield pd.DataFrame({"path": key[0], "line": batch["line"], "delta": (batch["total"] - previous).clip(lower=0)})

    def close(self) -> None:
        pass


def stream_deltas(lines: DataFrame) -> DataFrame:
    """(path, line, delta) of a stream of (path, line, total): what each total has gained, across micro-batches."""
    return lines.groupBy("path").transformWithStateInPandas(Deltas(), "path string, line long, delta long", "Append", "None")


SAID = ("session_id", "meta_provider", "full_model", "project_dir")
_LINE = ("line", "quiet", "broken", *SAID, "counts", "skip_reason", "time_created_utc", "ordinal", *(f"{p}_{k}" for p in "tl" for k in rollouts.STATED))
_RECORD = f"path string, line long, {', '.join(f'{c} string' for c in SAID)}, time_created_utc long, ordinal string, {', '.join(f'tok_{k} long' for k in rollouts.COUNTERS)}, regressed boolean"


class Rollouts(StatefulProcessor):
    """Follows each file line by line: what was said so far, the last totals, and lines that came before their turn."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        totals = ", ".join(f"t_{k} long" for k in rollouts.STATED)
        self.so_far = handle.getValueState("so_far", f"next long, waiting long, broken boolean, {', '.join(f'{c} string' for c in SAID)}, {totals}", self.idle_ms)
        self.early = handle.getMapState("early", "line long", "row string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.so_far.get() if self.so_far.exists() else (1, 0, False, *[None] * len(SAID), *[0] * len(rollouts.STATED))
        line, waiting, broken, said, totals = held[0], held[1], held[2], list(held[3 : 3 + len(SAID)]), list(held[3 + len(SAID) :])
        came = {r[0]: r for part in rows for r in part[list(_LINE)].astype(object).where(part[list(_LINE)].notna(), None).itertuples(index=False, name=None)}
        out = []
        while True:
            if line in came:
                row = came.pop(line)
            elif waiting and self.early.containsKey((line,)):
                row = json.loads(self.early.getValue((line,))[0])
                self.early.removeKey((line,))
                waiting -= 1
            else:
                break
            line += 1
            at = dict(zip(_LINE, row, strict=True))
            broken = broken or at["broken"]
            if broken or at["quiet"]:
                continue
            said = [said[i] if at[c] is None else at[c] for i, c in enumerate(SAID)]
            if not at["counts"] or at["skip_reason"] not in (None, "time_invalid"):
                continue
            new, stated = ([int(at[f"{p}_{k}"]) for k in rollouts.STATED] for p in "tl")
            fell, grew = any(a < b for a, b in zip(new, totals, strict=True)), any(a > b for a, b in zip(new, totals, strict=True))
            gain = stated if grew and not fell and any(stated) else [max(a - b, 0) for a, b in zip(new, totals, strict=True)]
            totals = new
            if at["time_created_utc"] is not None:
                out.append((key[0], int(at["line"]), *said, int(at["time_created_utc"]), at["ordinal"], *gain[: len(rollouts.COUNTERS)], fell))
        for n, row in came.items():
            if n > line and not self.early.containsKey((int(n),)):
                self.early.updateValue((int(n),), (json.dumps([x.item() if hasattr(x, "item") else x for x in row]),))
                waiting += 1
        self.so_far.update((int(line), waiting, bool(broken), *said, *totals))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _RECORD.split(", ")])

    def close(self) -> None:
        pass


def stream_rollouts(lines_: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The records of a stream of rollout lines (path, line, value): those that `rollouts.records` makes of all lines.

    Lines count from 1, blank ones too, and may come in any order and more than once: what comes before its turn waits
    in the state. After a malformed line nothing more of its file is told (a batch leaves the file out whole). With
    `idle_ms`, a file that nothing was heard of for so long leaves the state, with what waits in it; this is for streams
    that go on, as Spark then makes empty rounds for ever, also where it is to stop after what is there. Needs a state store with columns of
    its own for each state, such as RocksDB.
    """
    rows = lines.parsed(lines_)
    kind = exprs.text_or_number(rollouts.at("type"))
    object_ = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    rows = rows.withColumns({"quiet": F.trim("value") == "", "broken": (F.trim("value") != "") & ~object_, "counts": F.coalesce(rollouts.counts(kind), F.lit(False)), "time_created_utc": rollouts.created(), "ordinal": exprs.text_or_number(rollouts.at("ordinal"))} | rollouts.context(kind) | rollouts.stated())
    rows = rows.withColumn("skip_reason", rollouts.reason(F.col("time_created_utc"))).select("path", *_LINE)
    told = rows.groupBy("path").transformWithStateInPandas(Rollouts(idle_ms), _RECORD, "Append", "ProcessingTime" if idle_ms else "None")
    told = told.withColumns(rollouts.named(F.col("session_id"), F.col("meta_provider"), F.col("full_model"), F.col("ordinal")) | {"project_dir": F.coalesce("project_dir", F.lit("")), "is_incomplete": rollouts.incomplete()})
    return told.select(*rollouts.RECORD)
