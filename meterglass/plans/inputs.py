"""The usage fact and its small tables, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE_SQL = """
SELECT 'host-' || cast(user_id % 3 AS {S}) AS host_id,
 CASE event_type WHEN 'click' THEN 'opencode' WHEN 'view' THEN 'claude-code' WHEN 'purchase' THEN 'codex' WHEN 'signup' THEN 'hermes' ELSE 'opencode' END AS source,
 CASE WHEN event_type = 'signup' THEN 'session' ELSE 'message' END AS granularity,
 'msg-' || cast(event_id AS {S}) AS message_id,
 'ses-' || cast(user_id AS {S}) || '-' || cast(event_id % 4 AS {S}) AS session_id,
 {MS} + 5184000000 AS time_created_utc,
 CASE WHEN event_type = 'error' THEN NULL ELSE {MS} + 5184000500 END AS time_completed_utc,
 {MS} + 5184001000 AS source_time_updated,
 'live' AS origin, 3 AS origin_priority,
 CASE user_id % 4 WHEN 0 THEN 'Atlas - Plan Executor' WHEN 1 THEN 'Atlas Plan Executor' WHEN 2 THEN 'Build' ELSE '' END AS agent_raw,
 CASE user_id % 4 WHEN 0 THEN 'atlas-plan-executor' WHEN 1 THEN 'atlas-plan-executor' WHEN 2 THEN 'build' ELSE '' END AS agent_key,
 CASE event_id % 6 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'kiro-auth' WHEN 2 THEN 'openai' WHEN 3 THEN 'amazon-bedrock' WHEN 4 THEN 'kiro-auth' ELSE 'ollama' END AS provider_id,
 CASE event_id % 6 WHEN 0 THEN 'claude-opus-4-8' WHEN 1 THEN 'claude-opus-4-8-high' WHEN 2 THEN 'gpt-5.4-mini-fast' WHEN 3 THEN 'us.anthropic.claude-opus-4-8' WHEN 4 THEN 'private-model-xhigh' ELSE 'qwen3:8b' END AS model_id,
 CASE event_id % 5 WHEN 0 THEN 'xhigh' WHEN 1 THEN 'low' ELSE NULL END AS variant,
 CASE WHEN event_type = 'error' THEN 0 ELSE cast(floor(value * 100) AS bigint) END AS tok_input,
 CASE WHEN event_type = 'error' THEN 0 ELSE cast({K} AS bigint) END AS tok_output,
 CASE WHEN event_type = 'error' THEN 0 ELSE cast({K} AS bigint) % 7 END AS tok_reasoning,
 CASE WHEN event_type = 'error' THEN 0 ELSE (event_id % 9) * 1000 END AS tok_cache_read,
 CASE WHEN event_type = 'error' THEN 0 ELSE (event_id % 4) * 100 END AS tok_cache_write,
 CASE WHEN event_type = 'click' AND event_id % 10 < 3 THEN value / 1000 ELSE NULL END AS cost,
 CASE WHEN event_type = 'click' AND event_id % 10 < 3 THEN 'actual' ELSE 'unavailable' END AS cost_source,
 event_type = 'error' AS is_incomplete,
 '/work/p' || cast(user_id % 5 AS {S}) AS project_dir
FROM {EVENTS}
"""
DUCKDB = {"MS": "(epoch_us(ts) // 1000)", "K": "json_extract_string(props,'$.k')", "S": "varchar", "EVENTS": "events"}
SPARK = {"MS": "unix_millis(cast(ts as timestamp))", "K": "k", "S": "string", "EVENTS": "(SELECT *, get_json_object(props, '$.k') AS k FROM {events}) e"}
ARRIVALS = (
    # (priority, added to the update time, added to the input tokens, sequence, rows)
    (3, 0, 0, 2, "true"), (2, 5000, 1, 1, "time_created_utc % 5 = 0"), (1, 9000, 2, 3, "time_created_utc % 7 = 0"), (3, 0, 3, 4, "time_created_utc % 11 = 0"), (3, -1, 4, 5, "time_created_utc % 13 = 0"),
)
CATALOG = (
    (1, "anthropic", "claude-opus-4-8", 5.0, 25.0, 0.5, 6.25), (2, "amazon-bedrock", "anthropic.claude-opus-4-8", 5.5, 27.5, 0.55, 6.875),
    (3, "openai", "gpt-5.4-mini", 0.75, 4.5, 0.0, 0.0), (4, "openai", "gpt-5.4-nano", 0.2, 1.25, 0.0, 0.0),
)
CATALOG_COLUMNS = "catalog_ord, provider_id, model_id, input_per_mtok, output_per_mtok, cache_read_per_mtok, cache_write_per_mtok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schema import USAGE

    events = table(spark, sf_dir, "events")
    rows = spark.sql(USAGE_SQL.format(**SPARK), events=events)
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in USAGE))


def arrivals(usage_: DataFrame) -> DataFrame:
    out = None
    for priority, later, more, seq, rows in ARRIVALS:
        part = usage_.where(rows).select("host_id", "source", "message_id", F.lit(priority).alias("origin_priority"), (F.col("source_time_updated") + later).alias("source_time_updated"), (F.col("tok_input") + more).alias("tok_input"), F.lit(seq).alias("arrival_seq"))
        out = part if out is None else out.unionByName(part)
    return out


def catalog(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({a}, '{b}', '{c}', {d}D, {e}D, {f}D, {g}D)" for a, b, c, d, e, f, g in CATALOG)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({CATALOG_COLUMNS})")


def intervals(usage_: DataFrame) -> DataFrame:
    """Scanned windows: one pair starts a week late, one host misses a day, nothing after the month."""
    pairs = usage_.select("host_id", "source").distinct()
    late = F.when((F.col("host_id") == "host-1") & (F.col("source") == "codex"), 604800000).otherwise(0)
    end = F.when(F.col("host_id") == "host-2", 1710460800000).otherwise(1711929600000)
    first = pairs.select("host_id", "source", F.lit("live").alias("origin"), (F.lit(1709251200000) + late).alias("interval_start"), end.alias("interval_end"))
    second = pairs.where("host_id = 'host-2'").select("host_id", "source", F.lit("live").alias("origin"), F.lit(1710547200000).alias("interval_start"), F.lit(1711929600000).alias("interval_end"))
    return first.unionByName(second)


_ARRIVALS_SQL = " UNION ALL ".join(f"SELECT host_id, source, message_id, {p} AS origin_priority, source_time_updated + {d} AS source_time_updated, tok_input + {m} AS tok_input, {s} AS arrival_seq FROM usage_record WHERE {w}" for p, d, m, s, w in ARRIVALS)
_PRICES = ", ".join(f"({a}, '{b}', '{c}', {d}::double, {e}::double, {f}::double, {g}::double)" for a, b, c, d, e, f, g in CATALOG)
WITH = f"""WITH usage_record AS ({USAGE_SQL.format(**DUCKDB)}),
arrivals AS ({_ARRIVALS_SQL}),
catalog({CATALOG_COLUMNS}) AS (VALUES {_PRICES}),
coverage AS (
 SELECT host_id, source, 'live' AS origin, 1709251200000 + CASE WHEN host_id = 'host-1' AND source = 'codex' THEN 604800000 ELSE 0 END AS interval_start,
  CASE WHEN host_id = 'host-2' THEN 1710460800000 ELSE 1711929600000 END AS interval_end FROM (SELECT DISTINCT host_id, source FROM usage_record) p
 UNION ALL SELECT host_id, source, 'live', 1710547200000, 1711929600000 FROM (SELECT DISTINCT host_id, source FROM usage_record WHERE host_id = 'host-2') q)
"""
