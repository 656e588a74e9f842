"""Batches on the wire: a first line about the batch, then one record a line."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import USAGE
from . import lines as numbered

PROTOCOL = 1


class RejectedBatch(ValueError):
    """A batch whose first line doesn't fit."""


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


def meta(usage: DataFrame, since: int) -> DataFrame:
    """What a batch says of each pair: how many records, and up to when, never before `since`."""
    return usage.groupBy("host_id", "source").agg(F.count("*").alias("eligible_count"), F.greatest(F.max("source_time_updated"), F.lit(since)).alias("cutoff"), F.lit(since).alias("since"))


def lines(usage: DataFrame) -> DataFrame:
    """(host_id, source, value): records as JSON with names in camel case."""
    body = F.to_json(F.struct(*(F.col(f.name).alias(camel(f.name)) for f in USAGE)))
    return usage.select("host_id", "source", body.alias("value"))


def batch(usage: DataFrame, host_hash: str, hostname: str, version: str, since: int, folders: dict[str, str], skipped: dict[str, int] | None = None) -> DataFrame:
    """(line, value) of one host's batch: what it says of itself, then its records.

    folders: the data folder of each source that was scanned; each has an entry, with or without records.
    """
    sources = sorted(folders)
    said = usage.groupBy("source").agg(F.count("*").alias("n"), F.max("source_time_updated").alias("last"))
    listed = usage.sparkSession.createDataFrame([(s, folders[s], (skipped or {}).get(s, 0)) for s in sources], "source string, data_dir string, skipped_count bigint")
    rows = listed.join(said, "source", "left")
    entry = F.struct("source", "data_dir", F.struct(F.lit(since).cast("bigint").alias("since"), F.greatest(F.coalesce("last", F.lit(since)), F.lit(since)).cast("bigint").alias("cutoff")).alias("scan_window"), F.coalesce("n", F.lit(0)).cast("bigint").alias("eligible_count"), "skipped_count")
    head = rows.agg(F.array_sort(F.collect_list(entry)).alias("sources"))  # one entry a source
    first = F.to_json(F.struct(F.lit(PROTOCOL).alias("protocol_version"), F.lit(host_hash).alias("machine_id_hash"), F.lit(hostname).alias("hostname"), F.lit(version).alias("collector_version"), "sources"))
    body = lines(usage.where(F.col("source").isin(sources))).select((F.monotonically_increasing_id() + 2).alias("line"), "value")
    return head.select(F.lit(1).cast("bigint").alias("line"), first.alias("value")).union(body)


SOURCES = "array<struct<source:string,data_dir:string,scan_window:struct<since:bigint,cutoff:bigint>,eligible_count:bigint,skipped_count:bigint>>"


def header(rows: DataFrame, host_hash: str, source: str) -> dict:
    """What the first line of (line, value) says of a source; protocol, host and source must fit."""
    fields = f"protocol_version int, machine_id_hash string, hostname string, collector_version string, sources {SOURCES}"
    first = rows.where("line = 1").select(F.from_json("value", fields).alias("m")).select("m.*").first()
    if first is None or first["protocol_version"] != PROTOCOL:
        raise RejectedBatch("the protocol doesn't fit")
    if not re.fullmatch("[0-9a-f]+", first["machine_id_hash"] or "") or first["machine_id_hash"] != host_hash:
        raise RejectedBatch("the host doesn't fit")
    own = [x for x in first["sources"] or () if x["source"] == source]
    if not own:
        raise RejectedBatch(f"{source} is not among the sources")
    return {k: first[k] for k in ("machine_id_hash", "hostname", "collector_version")} | own[0].asDict(recursive=True)


def decode(rows: DataFrame, host_hash: str, source: str) -> DataFrame:
    """Records of one batch of (line, value): protocol, host and source must fit; records of other sources are ignored."""
    header(rows, host_hash, source)
    fields = ", ".join(f"{camel(f.name)} {f.dataType.simpleString()}" for f in USAGE)
    body = rows.where("line > 1 and trim(value) <> ''").select("line", "value", F.from_json("value", f"{fields}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    out = body.select("line", F.col("r._broken").alias("_broken"), *(F.col(f"r.{camel(f.name)}").alias(f.name) for f in USAGE)).where(F.col("_broken").isNotNull() | (F.col("source") == source))
    sure = F.when(F.col("_broken").isNotNull(), F.raise_error(F.concat(F.lit("malformed record in line "), F.col("line").cast("string"))).cast("string")).otherwise(F.coalesce("granularity", F.lit("message")))
    return out.withColumn("granularity", sure).select(*(f.name for f in USAGE))


def verified(rows: DataFrame, host_hash: str, source: str, since: int) -> tuple[DataFrame, dict]:
    """The records of a batch, once what arrived is what its first line says, and a report of it.

    Counts must be equal, and no record may be newer than the cutoff, which never goes back before `since`.
    """
    head = header(rows, host_hash, source)
    records = decode(rows, host_hash, source)
    came = records.agg(F.count("*").alias("n"), F.max("source_time_updated").alias("last"), F.count_distinct("message_id").alias("ids")).first()
    window = head["scan_window"]
    if came["n"] != head["eligible_count"]:
        raise RejectedBatch(f"{came['n']} records came, {head['eligible_count']} were announced")
    if came["ids"] != came["n"]:
        raise RejectedBatch("a record came twice")
    if came["last"] is not None and came["last"] > window["cutoff"]:
        raise RejectedBatch("a record is newer than the cutoff")
    report = {k: v for k, v in head.items() if k != "scan_window"} | {"since": window["since"], "cutoff": max(window["cutoff"], since)}
    return records, report


def read(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a batch that `write` wrote; the first line of its first file is line 1, others keep no order."""
    rows = numbered.read(spark, path, pattern="*.txt")
    first = rows.agg(F.min("path")).first()[0]
    return rows.select(F.when((F.col("path") == F.lit(first)) & (F.col("line") == 1), F.lit(1)).otherwise(F.col("line") + 1).alias("line"), "value")


def write(rows: DataFrame, path: str) -> None:
    """Writes a batch of (line, value) as text, lines in order across and within the files."""
    rows.repartitionByRange("line").sortWithinPartitions("line").select("value").write.mode("errorifexists").text(path)
