"""Exports of all tools as rows of the one usage fact, and what was skipped in each and why."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ORIGINS, USAGE, checked
from . import lines, messages, rollouts, sessions, tolerant, transcripts

#: What a record has where its source says nothing of it.
ABSENT = {"variant": None, "cost": None, "time_completed_utc": None, "cost_source": "unavailable", "agent_raw": "", "agent_key": "", "is_incomplete": False, "project_dir": ""}
SKIPS = "source string, skip_reason string, n bigint"
#: The columns of exports that are tables: messages, and sessions with the times of their messages.
MESSAGE = "id string, session_id string, time_created bigint, time_updated bigint, data string"
SESSION = (
    "id string, source string, model string, started_at double, ended_at double, billing_provider string, billing_base_url string, "
    "input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint"
)
SAID_AT = "session_id string, timestamp double"


def fact(rows: DataFrame, host_id: str, source: str, granularity: str, origin: str = "live") -> DataFrame:
    """Records of one source as fact rows. A record without an update time was last changed when it was created."""
    given = {"host_id": host_id, "source": source, "granularity": granularity, "origin": origin, "origin_priority": ORIGINS[origin]}
    rows = rows.withColumns({c: F.lit(v) for c, v in given.items()} | {c: F.lit(v) for c, v in ABSENT.items() if c not in rows.columns})
    if "source_time_updated" not in rows.columns:
        rows = rows.withColumn("source_time_updated", F.col("time_created_utc"))
    return checked(rows.select(*(F.col(f.name).cast(f.dataType) for f in USAGE)))


def _message_rows(rows: DataFrame, host_id: str, origin: str) -> tuple[DataFrame, DataFrame]:
    return checked(messages.records(rows, host_id, origin)), messages.skips(messages.normalised(rows))


def _legacy_files(rows: DataFrame, host_id: str, origin: str) -> tuple[DataFrame, DataFrame]:
    rows = messages.legacy(rows)
    return fact(rows.where("skip_reason is null"), host_id, "opencode", "message", "legacy" if origin == "live" else origin), messages.skips(rows)


def _transcript_lines(rows: DataFrame, host_id: str, origin: str) -> tuple[DataFrame, DataFrame]:
    rows = lines.parsed(rows)
    return fact(transcripts.records(rows), host_id, "claude-code", "message", origin), messages.skips(transcripts.normalised(rows.where(F.trim("value") != "")))


def _rollout_lines(rows: DataFrame, host_id: str, origin: str) -> tuple[DataFrame, DataFrame]:
    rows = lines.parsed(rows)
    return fact(rollouts.records(rows), host_id, "codex", "message", origin), rollouts.skips(rows)


def _session_rows(rows: DataFrame, host_id: str, origin: str) -> tuple[DataFrame, DataFrame]:
    rows = sessions.normalised(rows)
    return fact(rows.where("skip_reason is null"), host_id, sessions.SOURCE, "session", origin), messages.skips(rows)


#: By kind of export: its source's name, and what makes facts and skip counts of its rows.
ADAPTERS: dict[str, tuple[str, Callable[[DataFrame, str, str], tuple[DataFrame, DataFrame]]]] = {
    "messages": ("opencode", _message_rows), "legacy": ("opencode", _legacy_files), "transcripts": ("claude-code", _transcript_lines), "rollouts": ("codex", _rollout_lines), "sessions": (sessions.SOURCE, _session_rows),
}


def adapted(exports: dict[str, DataFrame], host_id: str, origin: str = "live") -> tuple[DataFrame, DataFrame]:
    """(fact rows of all exports, (source, skip_reason, n)); exports: by kind, the rows as `read` gives them.

    The fact can be ingested as it is: `schema.checked` has accepted each part. Nothing is deduplicated between exports,
    as the archive's merge does that by key and origin.
    """
    facts, skips = [], []
    for kind, rows in exports.items():
        source, adapter = ADAPTERS[kind]
        made, skipped = adapter(rows, host_id, origin)
        facts.append(made)
        skips.append(skipped.select(F.lit(source).alias("source"), "skip_reason", F.col("n").cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, facts), reduce(DataFrame.unionByName, skips).groupBy("source", "skip_reason").agg(F.sum("n").alias("n"))


def read(spark: SparkSession, kind: str, *paths: str) -> DataFrame:
    """The rows of an export: Parquet tables of messages, or of sessions and their messages; trees of JSON (lines) else."""
    if kind == "messages":
        return spark.read.parquet(*paths)
    if kind == "sessions":
        return sessions.with_activity(*(spark.read.parquet(p) for p in paths))
    if kind == "legacy":
        return lines.documents(spark, *paths)
    return lines.read(spark, *paths)


def scanned(spark: SparkSession, kind: str, host_id: str, folder: str, *paths: str, origin: str = "live", strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fact rows, skip counts, files) of an export, of which some files may be unreadable.

    files: (host_id, source, path, readable, error), as `coverage.with_holes` takes them. What is read is written to the
    folder, so that facts and counts don't read the export again. If strict, an unreadable file raises UnreadableFile,
    as for an export that came whole from another host. kind "sessions" takes two paths: sessions, and their messages.
    """
    if kind == "sessions":
        (told, files), (said, more) = (tolerant.tables(spark, f"{folder}/{n}", schema, p) for n, schema, p in zip(("sessions", "messages"), (SESSION, SAID_AT), paths, strict=True))
        rows, files = sessions.with_activity(told, said), files.unionByName(more)
    elif kind == "messages":
        rows, files = tolerant.tables(spark, folder, MESSAGE, *paths)
    else:
        rows, files = (tolerant.documents if kind == "legacy" else tolerant.lines)(spark, folder, *paths)
    if strict:
        tolerant.whole(files)
    facts, skips = adapted({kind: rows}, host_id, origin)
    return facts, skips, files.select(F.lit(host_id).alias("host_id"), F.lit(ADAPTERS[kind][0]).alias("source"), "path", "readable", "error")
