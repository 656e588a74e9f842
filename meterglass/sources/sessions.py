"""Session exports: one row a session, and its messages' times in another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


SOURCE = "hermes"
COUNTERS = {"tok_input": "input_tokens", "tok_output": "output_tokens", "tok_cache_read": "cache_read_tokens", "tok_cache_write": "cache_write_tokens", "tok_reasoning": "reasoning_tokens"}


def from_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages in the shape of the export, derived from the events table."""
    seconds, user = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.col("id")
    sessions = events.groupBy(F.col("user_id").alias("id")).agg(F.min(seconds).alias("started_at"), F.max(seconds).alias("last_at"), (F.sum(F.floor("value")) - 1500).alias("input_tokens"), F.count("*").alias("n"))
    model = F.expr("case id % 5 when 0 then 'global.anthropic.claude-x' when 1 then 'openai.gpt-5.4' when 2 then 'qwen3:8b' when 3 then 'custom:my-ollama:llama3' end")
    sessions = sessions.withColumns({
        "source": F.lit(None).cast("string"), "model": model, "ended_at": F.when(user % 3 != 0, F.col("last_at")), "billing_provider": F.when(user % 2 == 0, "custom").otherwise(""), "billing_base_url": F.when(user % 7 == 0, "http://box:11434/v1"),
        "output_tokens": F.col("n") * 3, "cache_read_tokens": F.col("n") * 2, "cache_write_tokens": F.col("n"), "reasoning_tokens": F.col("n"),
    }).drop("n", "last_at")
    return sessions, events.where("user_id % 7 <> 0").select(F.col("user_id").alias("session_id"), seconds.alias("timestamp"))


def with_activity(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds active_at: the time of the last message, or of the start where there is none."""
    last = messages.groupBy(F.col("session_id").alias("id")).agg(F.max("timestamp").alias("last"))
    return sessions.join(last, "id", "left").withColumn("active_at", F.coalesce("last", "started_at")).drop("last")


def normalised(sessions: DataFrame) -> DataFrame:
    """Adds the record's fields and skip_reason. Sessions are cumulative: a later read replaces the record.

    Columns that an export lacks count as absent; a session has no cost of its own and no variant, and is complete.
    """
    there = lambda c, kind: F.col(c) if c in sessions.columns else F.lit(None).cast(kind)
    agent = F.coalesce(F.nullif(F.trim(there("source", "string")), F.lit("")), F.lit("unknown"))
    counters = {t: F.coalesce(there(c, "bigint"), F.lit(0)).cast("bigint") for t, c in COUNTERS.items()}
    name, created, ended, updated = F.trim(F.col("id").cast("string")), X.seconds_to_ms(F.col("started_at")), X.seconds_to_ms(there("ended_at", "double")), X.seconds_to_ms(F.col("active_at"))
    reason = F.when(F.coalesce(name, F.lit("")) == "", "id_missing").when(created.isNull() | updated.isNull() | (ended.isNull() & there("ended_at", "double").isNotNull()), "time_invalid").when(F.least(*counters.values()) < 0, "tokens_negative")
    model = X.billed_model(there("billing_provider", "string"), there("billing_base_url", "string"), there("model", "string"), SOURCE)
    rows = sessions.withColumns(counters | {"_model": model, "skip_reason": reason, "time_created_utc": created, "time_completed_utc": ended, "source_time_updated": updated, "agent_raw": agent})
    return rows.withColumns({
        "message_id": name, "session_id": name, "source": F.lit(SOURCE), "granularity": F.lit("session"), "agent_key": X.agent_key(F.col("agent_raw")), "provider_id": F.col("_model.provider"), "model_id": F.col("_model.model"),
        "variant": F.lit(None).cast("string"), "cost": F.lit(None).cast("double"), "cost_source": F.lit("unavailable"), "is_incomplete": F.lit(False), "project_dir": F.lit(""),
    }).drop("_model")
