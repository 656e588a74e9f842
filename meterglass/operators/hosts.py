"""Hosts and their sources: which are to be collected, how fresh they are, and when they are due again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED = ("opencode", "claude-code", "codex", "hermes")


class InvalidSources(ValueError):
    """A list of enabled sources that breaks a rule."""


def encoded(sources: Column) -> Column:
    return F.array_join(sources, ",")


def decoded(text: Column) -> Column:
    """The list in one text: names are trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")


def sources_violation(sources: Column) -> Column:
    """What is wrong with a list of enabled sources, null for nothing."""
    unknown = F.filter(sources, lambda s: ~s.isin(*SUPPORTED))
    return (
        F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, "no source is enabled")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown source "), F.get(unknown, F.lit(0))))
        .when(F.size(F.array_distinct(sources)) < F.size(sources), "a source is named twice")
    )


def checked(hosts: DataFrame) -> DataFrame:
    """hosts (host_id, enabled_sources as text), if every list is valid."""
    bad = hosts.withColumn("why", sources_violation(decoded(F.col("enabled_sources")))).where("why is not null").first()
    if bad:
        raise InvalidSources(f"{bad['host_id']}: {bad['why']}")
    return hosts


def enabled(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows of pairs (host_id, source) that are collected: the host is known and has the source enabled."""
    pairs = hosts.select("host_id", F.explode(F.array_distinct(decoded(F.col("enabled_sources")))).alias("source"))
    return rows.join(pairs, ["host_id", "source"], "left_semi")


def with_status(hosts: DataFrame, statuses: DataFrame) -> DataFrame:
    """Hosts with their statuses as a list, the state that counts and the last success.

    statuses: host_id, source, state (idle, running, error), last_success. One failing source makes the host fail, then
    one that runs makes it run; without any its state is unknown. The newest success counts, else the host's own.
    """
    worst = F.max(F.when(F.col("state") == "error", 3).when(F.col("state") == "running", 2).otherwise(1))
    each = statuses.groupBy("host_id").agg(F.array_sort(F.collect_list(F.struct("source", "state", "last_success"))).alias("statuses"), worst.alias("_worst"), F.max("last_success").alias("_last"))
    state = F.when(F.col("_worst") == 3, "error").when(F.col("_worst") == 2, "running").when(F.col("_worst") == 1, "idle").otherwise("unknown")
    none = F.array().cast(each.schema["statuses"].dataType)
    out = hosts.join(each, "host_id", "left")
    return out.withColumns({"state": state, "last_success": F.coalesce("_last", "last_success"), "statuses": F.coalesce("statuses", none)}).drop("_worst", "_last")


def next_due(runs: DataFrame, now_ms: int) -> DataFrame:
    """Adds next_due and due to the slots (trigger, min_interval_ms, multiplier, last_completed, last_duration_ms).

    A slot waits for its least interval, or longer if its last run took long; one that never ran is due, one that is
    run by hand never.
    """
    wait = F.greatest("min_interval_ms", F.coalesce("last_duration_ms", F.lit(0)) * F.col("multiplier"))
    manual = F.col("trigger") == "manual"
    rows = runs.withColumn("next_due", F.when(~manual, F.col("last_completed") + wait))
    return rows.withColumn("due", ~manual & (F.col("last_completed").isNull() | (F.col("next_due") <= now_ms)))
