"""Transcripts: JSON lines of events, where one answer may be written several times, in several files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .messages import at

PROVIDER = "anthropic"


def normalised(lines: DataFrame) -> DataFrame:
    """Adds the record's fields and skip_reason to lines with v. A line that isn't JSON is skipped alone.

    A line without a working folder has the name of its file's folder instead, which is all that is known.

    Cache writes are the sum of the short and the long kind where these are told apart, else the plain counter.
    """
    usage = at("message.usage")
    count = lambda name: X.lossy_count(at(f"message.usage.{name}"))
    kinds = at("message.usage.cache_creation")
    split = F.coalesce(F.schema_of_variant(kinds).startswith("OBJECT"), F.lit(False))
    long = F.when(split, count("cache_creation.ephemeral_1h_input_tokens")).otherwise(F.lit(0))
    write = F.when(split, count("cache_creation.ephemeral_5m_input_tokens") + long).otherwise(count("cache_creation_input_tokens"))
    side = F.coalesce(F.try_variant_get("v", "$.isSidechain", "boolean"), F.lit(False))
    message, request = X.text_or_number(at("message.id")), X.text_or_number(at("requestId"))
    created = X.instant_ms(X.text_or_number(at("timestamp")))
    reason = (
        F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "not_json")
        .when(~F.coalesce(X.text_or_number(at("type")) == "assistant", F.lit(False)), "not_assistant")
        .when(usage.isNull() | ~F.schema_of_variant(usage).startswith("OBJECT"), "no_usage")
        .when(F.coalesce(message, F.lit("")) == "", "no_id")
        .when(created.isNull(), "time_invalid")
    )
    rows = lines.withColumns({
        "message_id": F.concat_ws("#", message, request), "request_id": request, "session_id": X.text_or_number(at("sessionId")), "time_created_utc": created, "agent_raw": F.when(side, "sidechain").otherwise("main"), "is_sidechain": side,
        "provider_id": F.lit(PROVIDER), "model_id": F.coalesce(X.text_or_number(at("message.model")), F.lit("unknown")), "tok_input": count("input_tokens"), "tok_output": count("output_tokens"), "tok_reasoning": F.lit(0).cast("bigint"),
        "tok_cache_read": count("cache_read_input_tokens"), "tok_cache_write": write, "long_cache": long, "flat_cache": count("cache_creation_input_tokens"), "has_speed": at("message.usage.speed").isNotNull(), "project_dir": F.coalesce(F.nullif(X.text_only(at("cwd")), F.lit("")), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)), "skip_reason": reason,
    })
    return rows.withColumns({"agent_key": F.col("agent_raw"), "is_incomplete": X.billable() == 0}).drop("v")


def winners(rows: DataFrame, keys: list[str], *better: Column) -> DataFrame:
    """One row a key: the greatest by the given columns. A plain aggregation, so the order of arrival doesn't matter."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*better)).alias("w")).select(*keys, *(f"w.{c}" for c in rest))


def records(lines: DataFrame) -> DataFrame:
    """The record of each answer: not from a side chain, most tokens, with a speed, first by (path, line)."""
    rows = normalised(lines).where("skip_reason is null")
    best = rows.groupBy("message_id").agg(F.max(F.struct(~F.col("is_sidechain"), X.all_tokens(), "has_speed")).alias("best"))
    top = rows.join(best, "message_id").where(F.struct(~F.col("is_sidechain"), X.all_tokens(), F.col("has_speed")) == F.col("best"))
    rest = [c for c in rows.columns if c != "message_id"]
    return top.groupBy("message_id").agg(F.min_by(F.struct(*rest), F.struct("path", "line")).alias("w")).select("message_id", "w.*")


def diagnostics(winners_: DataFrame) -> DataFrame:
    """Counts over winners; long cache writes cost more than is known, so costs are then a lower bound."""
    return winners_.agg(
        F.count_if(F.col("request_id").isNull()).alias("missing_request_id"), F.count_if(F.col("long_cache") > 0).alias("long_cache_rows"), F.coalesce(F.sum("long_cache"), F.lit(0)).alias("long_cache_tokens"),
        F.count_if(F.col("flat_cache") != F.col("tok_cache_write")).alias("mismatch"), F.count_if(X.is_placeholder(F.col("model_id"))).alias("placeholder_models"), F.coalesce(F.max(F.col("long_cache") > 0), F.lit(False)).alias("lower_bound"),
    )
