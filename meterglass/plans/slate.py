"""All queries over the usage operators, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import exprs as X
from ..operators import coverage as K
from ..operators import hosts as H
from ..operators import merge as M
from ..operators import pricing as P
from ..operators import reports as R
from ..streaming import archive as A
from ..streaming import rollup
from . import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ZONE = "America/New_York"
MARCH = C.LocalRange(date(2024, 3, 1), date(2024, 4, 1), ZONE)
WEEK = C.LocalRange(date(2024, 3, 8), date(2024, 3, 15), ZONE)
SPRING = C.LocalRange(date(2024, 3, 3), date(2024, 5, 20), ZONE)
NOW = 1710878400000
TOK = "tok_input + tok_output + tok_reasoning + tok_cache_read + tok_cache_write"
BILL = "tok_input + tok_output + tok_cache_read + tok_cache_write"


def query(sql: str | None = None, usage: bool = True) -> Callable:
    """Registers a query under its function's name. sql: what follows the common table expressions, or WITH ... itself."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (I.WITH if usage else "") + sql
        return f

    return put


def start_sql(day: str, zone: str = ZONE) -> str:
    return f"(epoch_us(timezone('{zone}', ({day})::timestamp)) // 1000)"


def range_sql(span: C.LocalRange) -> str:
    return f"time_created_utc >= {start_sql(f"DATE '{span.start}'")} AND time_created_utc < {start_sql(f"DATE '{span.end}'")}"


def days_sql(span: C.LocalRange) -> str:
    return f"(SELECT d::date AS day, {start_sql('d')} AS s, {start_sql("d + INTERVAL 1 DAY")} AS e FROM (SELECT unnest(generate_series(DATE '{span.start}', DATE '{span.end}' - 1, INTERVAL 1 DAY)) AS d) x)"


def spine_sql(span: C.LocalRange, unit: str) -> str:
    """(bucket_start, bucket_end, label) of the buckets, from day boundaries."""
    if unit == "hour":
        return f"(SELECT s + i * 3600000 AS bucket_start, least(s + (i + 1) * 3600000, e) AS bucket_end, day FROM (SELECT *, unnest(range(0, (e - s + 3599999) // 3600000)) AS i FROM {days_sql(span)}) y)"
    key = {"day": "day", "week": "date_trunc('week', day)", "month": "date_trunc('month', day)"}[unit]
    name = {"day": "strftime(min(day), '%Y-%m-%d')", "week": "strftime(date_trunc('week', min(day)), '%G-W%V')", "month": "strftime(min(day), '%Y-%m')"}[unit]
    return f"(SELECT min(s) AS bucket_start, max(e) AS bucket_end, {name} AS label FROM {days_sql(span)} z GROUP BY {key})"


# ---- scans and normalised records


@query("SELECT message_id, source_time_updated FROM usage_record WHERE source = 'opencode' AND source_time_updated >= 1710878400000 - 86400000")
def src_messages_window(spark, sf):
    rows = I.usage(spark, sf).where("source = 'opencode'")
    return M.within_overlap(rows, NOW, "source_time_updated").select("message_id", "source_time_updated")


SESSIONS = "SELECT user_id AS id, min(epoch_us(ts)) / 1e6 AS started_at, count(*) AS n, sum(floor(value))::bigint - 1500 AS tok FROM events GROUP BY 1"


@query(f"WITH s AS ({SESSIONS}), m AS (SELECT user_id AS session_id, max(epoch_us(ts)) / 1e6 AS last FROM events WHERE user_id % 7 <> 0 GROUP BY 1) SELECT id, cast(floor(coalesce(last, started_at) * 1000) AS bigint) AS active_ms FROM s LEFT JOIN m ON id = session_id", usage=False)
def src_session_last_activity(spark, sf):
    from ..sources import sessions as S

    return S.with_activity(*S.from_events(I.table(spark, sf, "events"))).select("id", X.seconds_to_ms(F.col("active_at")).alias("active_ms"))


RAW = """CASE event_id % 11
 WHEN 0 THEN '{"role":"user"}' WHEN 1 THEN '{"role":"assistant"}' WHEN 2 THEN '{"role":"assistant","tokens":"none"}'
 WHEN 3 THEN '{"role":"assistant","modelID":"m","providerID":"p","tokens":{"input":"' || cast(event_id AS varchar) || '","output":true}}'
 WHEN 4 THEN '{"role":"assistant","model":{"providerID":"p2","modelID":"m2"},"cost":0,"tokens":{"input":0,"output":0}}'
 WHEN 5 THEN 'not json'
 ELSE '{"role":"assistant","modelID":"m","providerID":"p","cost":0.5,"time":{"completed":5},"tokens":{"input":' || cast(event_id AS varchar) || ',"output":-3,"reasoning":2.75,"cache":{"read":7,"write":"x"}}}' END"""
REASON = "CASE event_id % 11 WHEN 0 THEN 'not_assistant' WHEN 1 THEN 'tokens_missing' WHEN 2 THEN 'tokens_invalid' WHEN 5 THEN 'not_json' END"


def raw_messages(spark, sf):
    return I.table(spark, sf, "events").select("event_id", F.expr(RAW.replace("varchar", "string")).alias("data"))


@query(
    "SELECT event_id, CASE WHEN event_id % 11 = 4 THEN 'p2' ELSE 'p' END AS provider_id, CASE WHEN event_id % 11 = 4 THEN 'm2' ELSE 'm' END AS model_id, CASE WHEN event_id % 11 = 4 THEN 0 ELSE event_id END AS tok_input, 0::bigint AS tok_output, "
    "CASE WHEN event_id % 11 IN (3, 4) THEN 0 ELSE 2 END::bigint AS tok_reasoning, CASE WHEN event_id % 11 IN (3, 4) THEN 0 ELSE 7 END::bigint AS tok_cache_read, CASE WHEN event_id % 11 IN (3, 4) THEN NULL ELSE 0.5 END::double AS cost, "
    "CASE WHEN event_id % 11 IN (3, 4) THEN 'unavailable' ELSE 'actual' END AS cost_source, (event_id % 11 = 4) OR (event_id % 11 = 3 AND event_id = 0) AS is_incomplete FROM events WHERE event_id % 11 NOT IN (0, 1, 2, 5)",
    usage=False,
)
def norm_messages(spark, sf):
    from ..sources import messages as S

    rows = S.normalised(raw_messages(spark, sf)).where("skip_reason is null")
    return rows.select("event_id", "provider_id", "model_id", "tok_input", "tok_output", "tok_reasoning", "tok_cache_read", "cost", "cost_source", "is_incomplete")


@query(f"SELECT {REASON} AS skip_reason, count(*) AS n FROM events WHERE event_id % 11 IN (0, 1, 2, 5) GROUP BY 1", usage=False)
def skip_breakdown(spark, sf):
    from ..sources import messages as S

    return S.skips(S.normalised(raw_messages(spark, sf)))


@query(
    f"WITH s AS ({SESSIONS}), m AS (SELECT user_id AS session_id, max(epoch_us(ts)) / 1e6 AS last FROM events WHERE user_id % 7 <> 0 GROUP BY 1) SELECT cast(id AS varchar) AS message_id, cast(floor(started_at * 1000) AS bigint) AS time_created_utc, cast(floor(coalesce(last, started_at) * 1000) AS bigint) AS source_time_updated, tok AS tok_input, 'unknown' AS agent_key, false AS is_incomplete FROM s LEFT JOIN m ON id = session_id WHERE tok >= 0",
    usage=False,
)
def norm_sessions(spark, sf):
    from ..sources import sessions as S

    rows = S.normalised(S.with_activity(*S.from_events(I.table(spark, sf, "events")))).where("skip_reason is null")
    return rows.select("message_id", "time_created_utc", "source_time_updated", "tok_input", "agent_key", "is_incomplete")


@query("SELECT host_id, source, count(*) AS eligible_count, max(source_time_updated) AS cutoff FROM usage_record GROUP BY 1, 2")
def wire_meta(spark, sf):
    from ..sources import wire

    return wire.meta(I.usage(spark, sf), since=0).select("host_id", "source", "eligible_count", "cutoff")


SESSION_MODEL = "CASE WHEN id % 5 = 0 THEN 'anthropic' WHEN id % 5 = 1 THEN 'openai' WHEN id % 5 IN (2, 3) OR id % 7 = 0 THEN 'ollama' WHEN id % 2 = 0 THEN 'custom' ELSE 'hermes' END AS provider_id, CASE id % 5 WHEN 0 THEN 'claude-x' WHEN 1 THEN 'gpt-5.4' WHEN 2 THEN 'qwen3:8b' WHEN 3 THEN 'llama3' ELSE 'unknown' END AS model_id"


@query(
    f"WITH s AS (SELECT user_id AS id, epoch_us(max(ts)) AS last_us, count(*) AS n, sum(floor(value))::bigint - 1500 AS tok FROM events GROUP BY 1) SELECT cast(id AS varchar) AS message_id, CASE WHEN id % 3 <> 0 THEN last_us // 1000 END AS time_completed_utc, tok AS tok_input, n * 3 AS tok_output, n AS tok_reasoning, n * 2 AS tok_cache_read, n AS tok_cache_write, {SESSION_MODEL}, 'session' AS granularity, 'unavailable' AS cost_source FROM s WHERE tok >= 0",
    usage=False,
)
def session_records(spark, sf):
    from ..sources import sessions as S

    rows = S.normalised(S.with_activity(*S.from_events(I.table(spark, sf, "events")))).where("skip_reason is null")
    return rows.select("message_id", "time_completed_utc", "tok_input", "tok_output", "tok_reasoning", "tok_cache_read", "tok_cache_write", "provider_id", "model_id", "granularity", "cost_source")


# a line of a transcript for each event; three after each other are copies of one answer
LINE = """'{"type":"' || CASE WHEN event_id % 11 = 10 THEN 'user' ELSE 'assistant' END || '","timestamp":' || cast({MS} AS {S}) || ',"sessionId":"s' || cast(user_id AS {S}) || '","requestId":"r' || cast(floor(event_id / 3) AS {S}) ||
 '","isSidechain":' || CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END || ',"message":{"id":"a' || cast(floor(event_id / 3) AS {S}) || '","model":"m","usage":{"input_tokens":' || cast(event_id % 100 AS {S}) || ',"output_tokens":' || cast(event_id % 13 AS {S}) || ',"cache_read_input_tokens":5,' ||
 CASE WHEN event_id % 2 = 0 THEN '"cache_creation":{"ephemeral_5m_input_tokens":2,"ephemeral_1h_input_tokens":3}' ELSE '"cache_creation_input_tokens":7' END || CASE WHEN event_id % 5 = 0 THEN ',"speed":"fast"' ELSE '' END || '}}}'"""


def transcript_lines(spark, sf):
    value = F.expr(LINE.replace("{MS}", "unix_millis(cast(ts as timestamp))").replace("{S}", "string"))
    return I.table(spark, sf, "events").select(F.expr("'f' || cast(event_id % 7 as string)").alias("path"), F.col("event_id").alias("line"), value.alias("value"))


@query(
    "WITH l AS (SELECT event_id // 3 AS answer, 'f' || cast(event_id % 7 AS varchar) AS path, event_id AS line, epoch_us(ts) // 1000 AS time_created_utc, user_id, event_id % 4 = 0 AS side, event_id % 100 AS tok_input, event_id % 13 AS tok_output, CASE WHEN event_id % 2 = 0 THEN 5 ELSE 7 END AS tok_cache_write, event_id % 5 = 0 AS fast FROM events WHERE event_id % 11 <> 10), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY side, tok_input + tok_output + 5 + tok_cache_write DESC, fast DESC, path, line) AS n FROM l) "
    "SELECT 'a' || cast(answer AS varchar) || '#r' || cast(answer AS varchar) AS message_id, 's' || cast(user_id AS varchar) AS session_id, line, time_created_utc, CASE WHEN side THEN 'sidechain' ELSE 'main' END AS agent_key, tok_input, tok_output, tok_cache_write FROM r WHERE n = 1",
    usage=False,
)
def norm_transcripts(spark, sf):
    from ..sources import lines as L
    from ..sources import transcripts as S

    return S.records(L.parsed(transcript_lines(spark, sf))).select("message_id", "session_id", "line", "time_created_utc", "agent_key", "tok_input", "tok_output", "tok_cache_write")


@query(
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 0 END AS n, CASE event_id % 5 WHEN 0 THEN event_id::double WHEN 1 THEN event_id + 0.5 WHEN 2 THEN NULL WHEN 3 THEN 2.9 ELSE -7.0 END AS d FROM events",
    usage=False,
)
def lossy_numbers(spark, sf):
    raw = F.expr("case event_id % 5 when 0 then cast(event_id as string) when 1 then concat('\"', cast(event_id as string), '.5\"') when 2 then 'true' when 3 then '2.9' else '\"-7\"' end")
    v = F.try_parse_json(raw)
    return I.table(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", X.lossy_count(F.col("v")).alias("n"), X.lossy_double(F.col("v")).alias("d"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE epoch_us(date_trunc('second', ts)) // 1000 - CASE event_id % 4 WHEN 1 THEN 7200000 ELSE 0 END END AS ms FROM events", usage=False)
def rfc3339_ms(spark, sf):
    plain = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    text = F.expr(f"case event_id % 4 when 0 then {plain} || 'Z' when 1 then {plain} || '+02:00' when 2 then cast(unix_seconds(cast(ts as timestamp)) * 1000 as string) else date_format(ts, 'yyyy-MM-dd') end")
    return I.table(spark, sf, "events").select("event_id", X.instant_ms(text).alias("ms"))


NAMES = "CASE c_custkey % 5 WHEN 0 THEN 'openai.gpt-5.4' WHEN 1 THEN 'plain' WHEN 2 THEN '' WHEN 3 THEN 'a1.b' ELSE 'x-y.z.w' END"


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'openai' WHEN 4 THEN 'x-y' ELSE 'codex' END AS provider, CASE c_custkey % 5 WHEN 0 THEN 'gpt-5.4' WHEN 1 THEN 'plain' WHEN 2 THEN 'unknown' WHEN 3 THEN 'a1.b' ELSE 'z.w' END AS model FROM customer", usage=False)
def provider_split(spark, sf):
    rows = I.table(spark, sf, "customer").select("c_custkey", X.split_namespace(F.expr(NAMES), "codex").alias("x"))
    return rows.select("c_custkey", "x.*")


@query("SELECT c_custkey, lower(trim(regexp_replace('  ' || c_name || ' - Plan  X ', '[\\s-]+', '-', 'g'), '-')) AS agent_key FROM customer", usage=False)
def agent_key(spark, sf):
    return I.table(spark, sf, "customer").select("c_custkey", X.agent_key(F.concat(F.lit("  "), "c_name", F.lit(" - Plan  X "))).alias("agent_key"))


@query("SELECT c_custkey, substr(sha256(trim('  ' || c_name || ' ')), 1, 16) AS host_id FROM customer", usage=False)
def host_hash(spark, sf):
    return I.table(spark, sf, "customer").select("c_custkey", X.host_id(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("host_id"))


# ---- filters


@query(f"SELECT host_id, source, message_id, time_created_utc FROM usage_record WHERE {range_sql(WEEK)}")
def filter_half_open(spark, sf):
    return R.filtered(I.usage(spark, sf), WEEK, complete=None).select("host_id", "source", "message_id", "time_created_utc")


@query(f"SELECT message_id FROM usage_record WHERE {range_sql(WEEK)} AND NOT is_incomplete AND host_id = 'host-1' AND provider_id = 'kiro-auth'")
def filters_conjunction(spark, sf):
    return R.filtered(I.usage(spark, sf), WEEK, host_id="host-1", source=None, provider_id="kiro-auth").select("message_id")


@query("SELECT message_id, is_incomplete FROM usage_record WHERE is_incomplete")
def detail_incomplete(spark, sf):
    return R.filtered(I.usage(spark, sf), complete=False).select("message_id", "is_incomplete")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 2000", usage=False)
def severity_filter(spark, sf):
    from ..sources import applog

    level = F.create_map(*map(F.lit, ("error", "error", "signup", "warn", "purchase", "info", "click", "debug", "view", "trace")))
    rows = I.table(spark, sf, "events").withColumn("level", F.element_at(level, F.col("event_type")))
    return applog.newest(applog.at_least(rows, "warn"), 5000, "ts", "event_id").select("event_id", "event_type")


@query("SELECT DISTINCT provider_id, model_id FROM usage_record WHERE contains(lower(provider_id), 'claude') OR contains(lower(model_id), 'claude')")
def model_search(spark, sf):
    return R.models_like(I.usage(spark, sf), "CLAUDE")


# ---- aggregates

SUMS = ", ".join(f"coalesce(sum({c}), 0)::bigint AS {c}" for c in ("tok_input", "tok_output", "tok_reasoning", "tok_cache_read", "tok_cache_write"))
COUNTS = "count(*) FILTER (granularity = 'message') AS messages, count(*) FILTER (granularity = 'session') AS session_records"


@query(f"SELECT {SUMS}, {COUNTS}, count(DISTINCT session_id) AS sessions FROM usage_record WHERE NOT is_incomplete AND {range_sql(MARCH)}")
def summary(spark, sf):
    return R.summary(R.filtered(I.usage(spark, sf), MARCH))


@query(f"SELECT source, {COUNTS} FROM usage_record WHERE NOT is_incomplete GROUP BY 1")
def granularity_counts(spark, sf):
    return R.filtered(I.usage(spark, sf)).groupBy("source").agg(*R.measures()).select("source", "messages", "session_records")


@query(f"SELECT source, sum({TOK})::bigint AS all_tokens, sum({BILL})::bigint AS billable, sum(tok_input + tok_cache_read + tok_cache_write)::bigint AS total_input, sum(tok_cache_read + tok_cache_write)::bigint AS cache FROM usage_record GROUP BY 1")
def token_sums(spark, sf):
    return I.usage(spark, sf).groupBy("source").agg(F.sum(X.all_tokens()).alias("all_tokens"), F.sum(X.billable()).alias("billable"), F.sum(X.total_input()).alias("total_input"), F.sum(X.cache_tokens()).alias("cache"))


# the match of each observed pair with this catalog, as the cascade must find it
MATCHES = "matches(provider_id, model_id, kind, cat) AS (VALUES ('anthropic','claude-opus-4-8','exact',1), ('kiro-auth','claude-opus-4-8-high','crossProvider',1), ('openai','gpt-5.4-mini-fast','crossProvider',3), ('amazon-bedrock','us.anthropic.claude-opus-4-8','normalized',2), ('kiro-auth','private-model-xhigh','unknown',NULL), ('ollama','qwen3:8b','unknown',NULL))"
ESTIMATE = "(tok_input / 1e6 * input_per_mtok + tok_output / 1e6 * output_per_mtok + tok_cache_read / 1e6 * cache_read_per_mtok + tok_cache_write / 1e6 * cache_write_per_mtok)"
PRICED = f""", {MATCHES}, priced AS (SELECT u.*, m.kind, {BILL} AS billable, u.cost IS NOT NULL AND isfinite(u.cost) AS trusted,
 CASE WHEN u.cost IS NOT NULL AND isfinite(u.cost) AND u.cost_source IN ('actual', 'estimated') THEN u.cost_source WHEN c.input_per_mtok IS NOT NULL THEN 'estimated' ELSE 'unavailable' END AS layer,
 CASE WHEN u.cost IS NOT NULL AND isfinite(u.cost) AND u.cost_source IN ('actual', 'estimated') THEN u.cost ELSE {ESTIMATE} END AS amount
 FROM usage_record u JOIN matches m USING (provider_id, model_id) LEFT JOIN catalog c ON c.catalog_ord = m.cat) """
MONEY = ", ".join(f"round(coalesce(sum(amount) FILTER (layer = '{x}' AND (trusted OR billable > 0)), 0), 6) AS {x}_sum" for x in ("actual", "estimated")) + ", " + ", ".join(f"count(*) FILTER (layer = '{x}' AND (trusted OR billable > 0)) AS {x}_count, coalesce(sum(billable) FILTER (layer = '{x}' AND (trusted OR billable > 0)), 0)::bigint AS {x}_tokens" for x in ("actual", "estimated", "unavailable"))


def priced(spark, sf, span=MARCH):
    u = R.filtered(I.usage(spark, sf), span)
    return P.priced(u, P.match(u, I.catalog(spark)))


@query(PRICED + f"SELECT {MONEY} FROM priced WHERE NOT is_incomplete AND {range_sql(MARCH)}")
def cost_layers(spark, sf):
    return P.summed_costs(R.filtered(I.usage(spark, sf), MARCH), I.catalog(spark))


@query(
    PRICED + f", c AS (SELECT {MONEY} FROM priced WHERE NOT is_incomplete AND {range_sql(MARCH)}), t AS (SELECT actual_tokens + estimated_tokens + unavailable_tokens AS w, * FROM c), "
    "l AS (SELECT w, 'actual' AS layer, actual_sum AS amount, actual_tokens AS tokens FROM t UNION ALL SELECT w, 'estimated', estimated_sum, estimated_tokens FROM t UNION ALL SELECT w, 'unavailable', NULL, unavailable_tokens FROM t) "
    "SELECT layer, amount, tokens, round(tokens / w::double, 6) AS share, round(amount / tokens * 1e6, 6) AS per_mtok FROM l"
)
def cost_tiers(spark, sf):
    return R.cost_tiers(P.summed_costs(R.filtered(I.usage(spark, sf), MARCH), I.catalog(spark)))


BREAK = f"{SUMS}, {COUNTS}, count(DISTINCT session_id) AS sessions, max(agent_raw) AS agent_label"


@query(f"SELECT source, agent_key, provider_id, model_id, NULL::varchar AS variant, {BREAK} FROM usage_record WHERE NOT is_incomplete GROUP BY 1, 2, 3, 4")
def breakdown_collapsed(spark, sf):
    return R.breakdown(R.filtered(I.usage(spark, sf)))


@query(f"SELECT source, agent_key, provider_id, model_id, variant, {BREAK} FROM usage_record WHERE NOT is_incomplete GROUP BY 1, 2, 3, 4, 5")
def breakdown_variant(spark, sf):
    return R.breakdown(R.filtered(I.usage(spark, sf)), by_variant=True)


# money of all rows that have any, to nine places, as prices of single tokens have no more; billable rows alone are counted
SERIES_MONEY = ", ".join(f"round(coalesce(sum(amount) FILTER (layer = '{x}' AND (trusted OR billable > 0)), 0), 9) AS {x}_sum" for x in ("actual", "estimated")) + ", " + ", ".join(f"count(*) FILTER (layer = '{x}' AND billable > 0) AS {x}_count, coalesce(sum(billable) FILTER (layer = '{x}' AND billable > 0), 0)::bigint AS {x}_tokens" for x in ("actual", "estimated", "unavailable"))


@query(PRICED + f"SELECT source, agent_key, provider_id, model_id, variant, {BREAK}, {SERIES_MONEY} FROM priced WHERE NOT is_incomplete AND {range_sql(MARCH)} GROUP BY 1, 2, 3, 4, 5")
def breakdown_costs(spark, sf):
    return R.breakdown_costs(priced(spark, sf), by_variant=True)


@query("SELECT agent_key, max(agent_raw) AS agent_label FROM usage_record GROUP BY 1")
def agent_label(spark, sf):
    return I.usage(spark, sf).groupBy("agent_key").agg(F.max("agent_raw").alias("agent_label"))


OBSERVED = f", {MATCHES}, observed AS (SELECT provider_id, model_id, count(*) AS records, any_value(kind) AS kind FROM usage_record JOIN matches USING (provider_id, model_id) WHERE {BILL} > 0 GROUP BY 1, 2) "


def observed(spark, sf):
    u = I.usage(spark, sf)
    return R.observed_models(u, P.match(u, I.catalog(spark)))


@query(OBSERVED + "SELECT * FROM observed")
def observed_models(spark, sf):
    return observed(spark, sf)


@query(OBSERVED + "SELECT provider_id, model_id, records FROM observed WHERE kind = 'unknown'")
def observed_unknown(spark, sf):
    return observed(spark, sf).where("kind = 'unknown'").select("provider_id", "model_id", "records")


@query(OBSERVED + ", k AS (SELECT *, CASE kind WHEN 'unknown' THEN 'unknown' WHEN 'crossProvider' THEN 'inferred' ELSE 'approximate' END AS class FROM observed WHERE kind <> 'exact') SELECT class, row_number() OVER (PARTITION BY class ORDER BY records DESC, provider_id, model_id) AS place, provider_id, model_id, records FROM k")
def observed_classes(spark, sf):
    return R.observed_classes(observed(spark, sf))


@query(OBSERVED + ", p AS (SELECT provider_id, sum(records)::bigint AS records FROM (SELECT provider_id, records FROM observed UNION ALL SELECT provider_id, 0 FROM catalog) x GROUP BY 1) SELECT row_number() OVER (ORDER BY records DESC, provider_id) AS place, * FROM p")
def provider_rank(spark, sf):
    return R.provider_rank(observed(spark, sf), I.catalog(spark))


@query(PRICED + f"SELECT provider_id, model_id, count(*) AS records FROM priced WHERE NOT is_incomplete AND billable > 0 AND layer = 'unavailable' AND {range_sql(MARCH)} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5")
def missing_prices(spark, sf):
    return R.missing_prices(priced(spark, sf)).orderBy(F.desc("records"), "provider_id", "model_id").limit(5)


@query(PRICED + f"SELECT greatest(0, count(*) FILTER (layer = 'unavailable' AND (trusted OR billable > 0)) - count(*) FILTER (layer = 'unavailable' AND billable > 0)) AS unattributed FROM priced WHERE NOT is_incomplete AND {range_sql(MARCH)}")
def missing_unattributed(spark, sf):
    rows = priced(spark, sf)
    out = F.col("layer") == "unavailable"
    return rows.agg(F.greatest(F.lit(0).cast("bigint"), F.count_if(out & P.in_summary()) - F.count_if(out & X.is_billable())).alias("unattributed"))


DAY_KEY = f"day, s, e FROM {days_sql(C.LocalRange(date(2024, 2, 28), date(2024, 4, 5), ZONE))}"


@query(f", d AS (SELECT {DAY_KEY} q) SELECT day, " + ", ".join(f"coalesce(sum({c}) FILTER (NOT is_incomplete), 0)::bigint AS {c}" for c in ("tok_input", "tok_output", "tok_reasoning", "tok_cache_read", "tok_cache_write")) + ", round(coalesce(sum(cost) FILTER (NOT is_incomplete), 0), 6) AS cost, count(*) FILTER (NOT is_incomplete) AS records, count(DISTINCT session_id) FILTER (NOT is_incomplete) AS sessions, count(*) FILTER (is_incomplete) AS incomplete FROM usage_record JOIN d ON time_created_utc >= s AND time_created_utc < e GROUP BY 1")
def daily_expectations(spark, sf):
    return R.daily(I.usage(spark, sf), ZONE)


@query("SELECT host_id, CASE WHEN max(is_incomplete::int) = 1 THEN 'error' ELSE 'idle' END AS state, max(time_completed_utc) AS last_success FROM usage_record GROUP BY 1")
def source_freshness(spark, sf):
    return I.usage(spark, sf).groupBy("host_id").agg(F.when(F.bool_or("is_incomplete"), "error").otherwise("idle").alias("state"), F.max("time_completed_utc").alias("last_success"))


# ---- trends and calendar


def trend_query(unit, span):
    def f(spark, sf):
        u = R.filtered(I.usage(spark, sf), span)
        series = R.trend(u, span, unit).select("bucket_start", X.all_tokens().alias("tokens"), "messages")
        return R.dense(C.spine(spark, span, unit), series, "tokens", "messages").drop("label" if unit == "hour" else "")

    f.__name__ = f"trend_{unit}"
    name = "" if unit == "hour" else "label, "
    f = query(f", b AS {spine_sql(span, unit)} SELECT bucket_start, bucket_end, {name}coalesce(sum({TOK}), 0)::bigint AS tokens, count(*) FILTER (granularity = 'message') AS messages FROM b LEFT JOIN (SELECT * FROM usage_record WHERE NOT is_incomplete) u ON time_created_utc >= bucket_start AND time_created_utc < bucket_end GROUP BY ALL")(f)
    return f


trend_hour, trend_day = trend_query("hour", WEEK), trend_query("day", MARCH)
trend_week, trend_month = trend_query("week", SPRING), trend_query("month", SPRING)


@query(f", b AS {spine_sql(MARCH, 'day')} SELECT bucket_start, source, count(*) AS records FROM b JOIN usage_record ON time_created_utc >= bucket_start AND time_created_utc < bucket_end GROUP BY 1, 2")
def trend_day_rangejoin(spark, sf):
    u = R.filtered(I.usage(spark, sf), MARCH, complete=None)
    return u.groupBy(C.bucket_start(F.col("time_created_utc"), "day", MARCH).alias("bucket_start"), "source").agg(F.count("*").alias("records"))


BUNDLE = f", b AS {spine_sql(MARCH, 'day')}, r AS (SELECT bucket_start, u.*, {TOK} AS tokens FROM b JOIN usage_record u ON time_created_utc >= bucket_start AND time_created_utc < bucket_end WHERE NOT is_incomplete) "


@query(BUNDLE + " UNION ALL ".join(f"SELECT bucket_start, '{d}' AS dimension, {a} AS id, {b} AS id2, sum(tokens)::bigint AS tokens, count(*) FILTER (granularity = 'message') AS messages FROM r GROUP BY ALL" for d, a, b in (("total", "''", "''"), ("source", "source", "''"), ("agent", "agent_key", "''"), ("provider", "provider_id", "''"), ("model", "provider_id", "model_id"))))
def trend_bundle(spark, sf):
    return R.trend_bundle(R.filtered(I.usage(spark, sf), MARCH), MARCH, "day")


@query(
    PRICED + f", b AS {spine_sql(MARCH, 'day')}, r AS (SELECT bucket_start, p.* FROM b JOIN priced p ON time_created_utc >= bucket_start AND time_created_utc < bucket_end WHERE NOT is_incomplete) "
    + " UNION ALL ".join(f"SELECT bucket_start, '{d}' AS dimension, {a} AS id, {b} AS id2, {SUMS}, {COUNTS}, {SERIES_MONEY}, {'max(agent_raw)' if d == 'agent' else 'NULL::varchar'} AS label FROM r GROUP BY bucket_start, {a if a != chr(39) * 2 else 'bucket_start'}, {b if b != chr(39) * 2 else 'bucket_start'}" for d, a, b in (("total", "''", "''"), ("source", "source", "''"), ("agent", "agent_key", "''"), ("provider", "provider_id", "''"), ("model", "provider_id", "model_id")))
)
def trend_costs(spark, sf):
    return R.trend_costs(R.filtered(I.usage(spark, sf), MARCH), I.catalog(spark), MARCH, "day")


@query(BUNDLE + ", w AS (SELECT model_id, sum(tokens) AS w FROM r GROUP BY 1 HAVING sum(tokens) > 0 ORDER BY 2 DESC, 1 LIMIT 3) SELECT bucket_start, CASE WHEN model_id IN (SELECT model_id FROM w) THEN model_id ELSE 'other' END AS id, sum(tokens)::bigint AS tokens FROM r GROUP BY 1, 2")
def trend_topn_other(spark, sf):
    u = R.filtered(I.usage(spark, sf), MARCH)
    series = u.groupBy(C.bucket_start(F.col("time_created_utc"), "day", MARCH).alias("bucket_start"), F.col("model_id").alias("id")).agg(F.sum(X.all_tokens()).alias("tokens"))
    return R.top_groups(series, 3)


STATUS = f", b AS {spine_sql(MARCH, 'day')}, pp AS (SELECT bucket_start, bucket_end, label, host_id, source, bool_or(interval_start <= bucket_start AND interval_end >= bucket_end) AS covers, bool_or(interval_start < bucket_end AND interval_end > bucket_start) AS meets FROM b CROSS JOIN coverage GROUP BY ALL), st AS (SELECT bucket_start, bucket_end, label, CASE WHEN NOT bool_or(meets) THEN 'none' WHEN bool_and(covers) THEN 'full' ELSE 'partial' END AS coverage FROM pp GROUP BY ALL) "


def march_spine(spark):
    return C.spine(spark, MARCH, "day")


@query(STATUS + "SELECT * FROM st")
def coverage_status(spark, sf):
    return K.status(march_spine(spark), I.intervals(I.usage(spark, sf)))


@query(
    STATUS + f", n AS (SELECT label, bucket_start <= {NOW} AND {NOW} < bucket_end AS in_progress, coalesce(string_agg(host_id || '/' || source, ',' ORDER BY host_id || '/' || source) FILTER (meets), '') AS partial, coalesce(string_agg(host_id || '/' || source, ',' ORDER BY host_id || '/' || source) FILTER (NOT meets), '') AS missing FROM pp WHERE NOT covers GROUP BY ALL), m AS (SELECT label, in_progress, CASE WHEN in_progress THEN '' ELSE partial END AS partial, missing FROM n) SELECT * FROM m WHERE partial <> '' OR missing <> ''"
)
def coverage_notes(spark, sf):
    rows = K.notes(march_spine(spark), I.intervals(I.usage(spark, sf)), NOW)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("partial", "missing")})


@query(STATUS + f"SELECT st.bucket_start, bucket_end, label, coverage, CASE WHEN coverage <> 'none' THEN coalesce(tokens, 0) END::bigint AS tokens FROM st LEFT JOIN (SELECT bucket_start, sum({TOK}) AS tokens FROM b JOIN usage_record ON time_created_utc >= bucket_start AND time_created_utc < bucket_end WHERE NOT is_incomplete GROUP BY 1) r ON r.bucket_start = st.bucket_start")
def trend_masked(spark, sf):
    u = I.usage(spark, sf)
    return R.masked_trend(R.filtered(u, MARCH), I.intervals(u), march_spine(spark), MARCH, "day")


@query(f"SELECT o_orderdate::date AS day, {start_sql('o_orderdate::date')} AS starts, {start_sql('o_orderdate::date', 'Asia/Beirut')} AS beirut FROM (SELECT DISTINCT o_orderdate FROM orders) x", usage=False)
def day_bounds(spark, sf):
    days = I.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", C.day_start(F.col("day"), ZONE).alias("starts"), C.day_start(F.col("day"), "Asia/Beirut").alias("beirut"))


@query("SELECT message_id, strftime(timezone('America/New_York', to_timestamp(time_created_utc // 1000)), '%Y-%m-%d %H:%M:%S') AS local, strftime(timezone('America/New_York', to_timestamp(time_created_utc // 1000)), '%G-W%V') AS week FROM usage_record")
def labels(spark, sf):
    t = F.col("time_created_utc")
    return I.usage(spark, sf).select("message_id", C.local_text(t, ZONE).alias("local"), C.label(t, C.local_date(t, ZONE), "week", MARCH).alias("week"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(timezone('America/New_York', date_trunc('second', ts) AT TIME ZONE 'UTC' - INTERVAL 2 HOUR), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE 'never' END AS shown FROM events", usage=False)
def rezoned(spark, sf):
    plain = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    stamp = F.expr(f"case event_id % 3 when 0 then {plain} || '+02:00' when 1 then {plain} else 'never' end")
    return I.table(spark, sf, "events").select("event_id", C.rezoned_text(stamp, ZONE).alias("shown"))


PRESET_SQL = " UNION ALL ".join(f"SELECT '{p}' AS preset, sum({TOK})::bigint AS tokens, count(*) AS records FROM usage_record WHERE NOT is_incomplete AND time_created_utc >= {start_sql(f"DATE '{d}'")} AND time_created_utc < {start_sql("DATE '2024-03-20'")}" for p, d in (("today", "2024-03-19"), ("last_7", "2024-03-13"), ("last_30", "2024-02-19"), ("quarter", "2024-01-01"), ("year", "2024-01-01")))


@query(PRESET_SQL)
def preset_summary(spark, sf):
    return R.presets(R.filtered(I.usage(spark, sf)), ZONE, NOW)


# ---- coverage windows

SPANS = "SELECT o_custkey, o_orderdate::date AS d, o_orderdate::date + (o_orderkey % 60)::int AS e FROM orders"


@query(f"WITH i AS ({SPANS}), r AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY d, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), g AS (SELECT *, sum(CASE WHEN d <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY d, e ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT o_custkey, min(d) AS interval_start, max(e) AS interval_end FROM g GROUP BY o_custkey, island", usage=False)
def interval_union(spark, sf):
    day = F.to_date("o_orderdate")
    rows = I.table(spark, sf, "orders").select("o_custkey", day.alias("interval_start"), F.date_add(day, (F.col("o_orderkey") % 60).cast("int")).alias("interval_end"))
    return K.union_intervals(rows, "o_custkey")


@query("SELECT host_id, source, origin, min(interval_start) AS interval_start, max(interval_end) AS interval_end FROM (SELECT * FROM coverage UNION ALL SELECT host_id, source, 'live', min(time_created_utc), max(time_created_utc) + 1 FROM usage_record GROUP BY 1, 2) x GROUP BY 1, 2, 3")
def coverage_extend(spark, sf):
    u = I.usage(spark, sf)
    return K.extend(I.intervals(u), K.observed_span(u).withColumn("origin", F.lit("live")))


@query("SELECT host_id, source, origin, min(interval_start) AS interval_start, greatest(max(interval_end), 1712000000000) AS interval_end FROM coverage WHERE source <> 'codex' GROUP BY 1, 2, 3 UNION ALL SELECT host_id, source, 'live', min(time_created_utc), greatest(max(time_created_utc), 1712000000000) FROM usage_record WHERE source = 'codex' GROUP BY 1, 2")
def coverage_cutoff(spark, sf):
    u = I.usage(spark, sf)
    rounds = u.groupBy("host_id", "source").agg(F.min("time_created_utc").alias("earliest"), F.greatest(F.max("time_created_utc"), F.lit(1712000000000)).alias("cutoff"))
    later = rounds.withColumns({"earliest": F.when(F.col("source") == "codex", F.col("earliest")), "cutoff": F.when(F.col("source") == "codex", F.col("cutoff")).otherwise(F.lit(1712000000000))})
    return K.extend_to_cutoff(I.intervals(u).where("source <> 'codex'"), later)


@query(STATUS + f", n AS (SELECT label, coalesce(string_agg(host_id || '/' || source, ',' ORDER BY host_id || '/' || source) FILTER (meets AND NOT ({NOW} >= bucket_start AND {NOW} < bucket_end)), '') AS partial, coalesce(string_agg(host_id || '/' || source, ',' ORDER BY host_id || '/' || source) FILTER (NOT meets), '') AS missing FROM pp WHERE NOT covers GROUP BY ALL) SELECT label, coverage, bucket_start <= {NOW} AND {NOW} < bucket_end AS in_progress, concat_ws(',', nullif(partial, ''), nullif(missing, '')) AS pairs, false AS unknown FROM st JOIN n USING (label) WHERE coverage <> 'full'")
def coverage_explained(spark, sf):
    rows = K.explained(march_spine(spark), I.intervals(I.usage(spark, sf)), NOW)
    return rows.withColumn("pairs", F.array_join("pairs", ","))


@query(f"SELECT host_id, source, 0::bigint AS interval_start, CASE WHEN bool_or(message_id LIKE '%77') THEN 0 ELSE {NOW} END::bigint AS interval_end, count(*) FILTER (message_id LIKE '%77') AS unreadable FROM usage_record GROUP BY 1, 2")
def coverage_holes(spark, sf):
    files = I.usage(spark, sf).select("host_id", "source", (~F.col("message_id").like("%77")).alias("readable"))
    return K.with_holes(files, NOW, 0)


@query("SELECT host_id, source, min(time_created_utc) AS interval_start, max(time_created_utc) + 1 AS interval_end FROM usage_record GROUP BY 1, 2")
def observed_span(spark, sf):
    return K.observed_span(I.usage(spark, sf))


# ---- prices


@query("SELECT DISTINCT provider_id, model_id, CASE model_id WHEN 'us.anthropic.claude-opus-4-8' THEN 'claude-opus-4-8' WHEN 'qwen3:8b' THEN 'qwen3-8b' WHEN 'gpt-5.4-mini-fast' THEN 'gpt-5-4-mini-fast' ELSE model_id END AS nm, CASE model_id WHEN 'us.anthropic.claude-opus-4-8' THEN 'claude-opus-4-8' WHEN 'claude-opus-4-8-high' THEN 'claude-opus-4-8' WHEN 'gpt-5.4-mini-fast' THEN 'gpt-5-4-mini' WHEN 'private-model-xhigh' THEN 'private-model' WHEN 'qwen3:8b' THEN 'qwen3-8b' ELSE model_id END AS pm FROM usage_record")
def model_identity(spark, sf):
    return P.identities(I.usage(spark, sf).select("provider_id", "model_id").distinct()).select("provider_id", "model_id", "nm", "pm")


@query(f", {MATCHES} SELECT DISTINCT provider_id, model_id, m.kind, c.input_per_mtok FROM usage_record JOIN matches m USING (provider_id, model_id) LEFT JOIN catalog c ON c.catalog_ord = m.cat")
def price_match(spark, sf):
    return P.match(I.usage(spark, sf), I.catalog(spark)).select("provider_id", "model_id", "kind", "input_per_mtok")


@query(
    "WITH c AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d')::bigint AS v FROM orders WHERE o_orderkey % 50 = 0), a AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d')::bigint AS v FROM orders WHERE o_orderkey % 7 = 1), r AS (SELECT a.v AS asked, c.v, row_number() OVER (PARTITION BY a.v ORDER BY abs(a.v - c.v), c.v DESC) AS n FROM a CROSS JOIN c) SELECT asked, CASE WHEN asked = v THEN 'exact' ELSE 'family' END AS kind, v::double AS version FROM r WHERE n = 1",
    usage=False,
)
def price_family(spark, sf):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    orders = I.table(spark, sf, "orders").withColumn("v", day)
    name = F.concat(F.lit("model-"), "v").alias("model_id")
    catalog = orders.where("o_orderkey % 50 = 0").select("v").distinct().select(F.col("v").cast("int").alias("catalog_ord"), F.lit("p").alias("provider_id"), name, *(F.col("v").cast("double").alias(p) for p in P.PRICES))
    asked = orders.where("o_orderkey % 7 = 1").select(F.lit("p").alias("provider_id"), name).distinct()
    return P.match(asked, catalog).select(F.substring("model_id", 7, 8).cast("bigint").alias("asked"), "kind", F.col("input_per_mtok").alias("version"))


@query(f", {MATCHES} SELECT DISTINCT provider_id, model_id, CASE WHEN provider_id = 'ollama' THEN 'exact' ELSE m.kind END AS kind, CASE WHEN provider_id = 'ollama' THEN 1.5 ELSE c.input_per_mtok END AS input_per_mtok FROM usage_record JOIN matches m USING (provider_id, model_id) LEFT JOIN catalog c ON c.catalog_ord = m.cat")
def price_override(spark, sf):
    own = spark.sql("SELECT 'ollama' AS provider_id, 'qwen3:8b' AS model_id, 1.5D AS input_per_mtok, 2D AS output_per_mtok, 0D AS cache_read_per_mtok, 0D AS cache_write_per_mtok")
    return P.match(I.usage(spark, sf), I.catalog(spark), own).select("provider_id", "model_id", "kind", "input_per_mtok")


@query(PRICED + f"SELECT message_id, round({ESTIMATE}, 9) AS estimate FROM usage_record JOIN matches m USING (provider_id, model_id) JOIN catalog c ON c.catalog_ord = m.cat")
def price_estimate(spark, sf):
    u = I.usage(spark, sf)
    m = P.match(u, I.catalog(spark)).where("input_per_mtok is not null")
    return u.join(m, ["provider_id", "model_id"]).select("message_id", F.round(P.estimate(), 9).alias("estimate"))


# ---- drilldown and detail


def drill_sql(keys: str, extra: str, level: str) -> str:
    over = f"OVER (PARTITION BY {level})" if level else "OVER ()"
    return f", g AS (SELECT {keys}, sum({TOK})::bigint AS tokens, count(*) AS records, {extra} FROM usage_record WHERE NOT is_incomplete GROUP BY ALL) SELECT *, round(tokens / (sum(tokens) {over})::double, 6) AS share FROM g"


@query(drill_sql("source", "count(DISTINCT agent_key) AS agents", ""))
def drill_source(spark, sf):
    return R.drill(R.filtered(I.usage(spark, sf)), "source")


@query(drill_sql("source, agent_key", "count(DISTINCT provider_id || chr(9) || model_id) AS models, max_by(agent_raw, provider_id || chr(9) || model_id || chr(9) || coalesce(variant, '') || chr(9) || agent_raw) AS agent_label", "source"))
def drill_agent(spark, sf):
    return R.drill(R.filtered(I.usage(spark, sf)), "agent")


@query(drill_sql("source, agent_key, provider_id, model_id", "count(DISTINCT coalesce(variant, '')) AS variants", "source, agent_key"))
def drill_model(spark, sf):
    return R.drill(R.filtered(I.usage(spark, sf)), "model")


@query(f", v AS (SELECT source, agent_key, provider_id, model_id, coalesce(variant, '') AS id, sum({TOK})::bigint AS t, count(*) AS n FROM usage_record WHERE NOT is_incomplete GROUP BY ALL) SELECT source, agent_key, provider_id, model_id, sum(t)::bigint AS tokens, sum(n)::bigint AS records, string_agg(id || ':' || t || ':' || n, ',' ORDER BY t DESC, id) AS variants FROM v GROUP BY 1, 2, 3, 4")
def drill_variants(spark, sf):
    rows = R.variants(R.filtered(I.usage(spark, sf)))
    return rows.withColumn("variants", F.array_join(F.transform("variants", lambda v: F.concat_ws(":", v["id"], v["tokens"].cast("string"), v["records"].cast("string"))), ","))


@query(f", g AS (SELECT source, sum({TOK}) AS t FROM usage_record WHERE NOT is_incomplete GROUP BY 1) SELECT source, round(t / (sum(t) OVER ())::double, 6) AS share FROM g")
def drill_share(spark, sf):
    return R.drill(R.filtered(I.usage(spark, sf)), "source").select("source", "share")


@query("SELECT host_id, source, message_id, time_created_utc FROM usage_record ORDER BY time_created_utc DESC, message_id, host_id, source LIMIT 200 OFFSET 100")
def detail_page(spark, sf):
    return R.detail(I.usage(spark, sf).select("host_id", "source", "message_id", "time_created_utc"), 500, 100)


@query("SELECT host_id, source, message_id, time_created_utc, tok_input FROM usage_record WHERE tok_input % 3 = 0 ORDER BY time_created_utc DESC, message_id, host_id, source LIMIT 150 OFFSET 300")
def detail_seek(spark, sf):
    """The third page of an archive, with a condition; each page begins after the last row of the one before."""
    folder = f"{A.scratch(spark)}/archive-{uuid.uuid4().hex}"
    A.publish(I.usage(spark, sf), folder, 0)
    page = lambda after: A.page(spark, folder, 150, after, where=F.col("tok_input") % 3 == 0)
    after = None
    for _ in range(2):
        last = page(after).select("time_created_utc", *R.PAGED).tail(1)
        after = tuple(last[0]) if last else (-(1 << 63), "", "", "")
    return page(after).select("host_id", "source", "message_id", "time_created_utc", "tok_input")


@query(PRICED + "SELECT message_id, host_id, CASE WHEN layer = 'actual' THEN round(amount, 9) END AS actual, CASE WHEN layer = 'estimated' THEN round(amount, 9) END AS estimated, layer = 'unavailable' AS unavailable FROM priced ORDER BY time_created_utc DESC, message_id, host_id, source LIMIT 200")
def detail_costs(spark, sf):
    page = R.detail(I.usage(spark, sf), 200)
    rows = R.detail_costs(page, P.match(page, I.catalog(spark)))  # prices for the models of the page alone
    return rows.select("message_id", "host_id", F.round("actual", 9).alias("actual"), F.round("estimated", 9).alias("estimated"), "unavailable")


# ---- hosts and their sources

HOSTS = "SELECT host_id, CASE host_id WHEN 'host-0' THEN 'opencode, codex' WHEN 'host-1' THEN ' hermes,,opencode ' ELSE 'claude-code' END AS enabled_sources FROM (SELECT DISTINCT host_id FROM {usage} UNION ALL SELECT 'host-9') h"


def hosts(spark, sf):
    return spark.sql(HOSTS.format(usage="{u}"), u=I.usage(spark, sf))


@query(f", h AS ({HOSTS.format(usage='usage_record')}), e AS (SELECT host_id, trim(unnest(string_split(enabled_sources, ','))) AS source FROM h) SELECT host_id, source, count(*) AS records FROM usage_record SEMI JOIN e USING (host_id, source) GROUP BY 1, 2")
def enabled_sources(spark, sf):
    return H.enabled(I.usage(spark, sf), H.checked(hosts(spark, sf))).groupBy("host_id", "source").agg(F.count("*").alias("records"))


SLOTS = "SELECT host_id, source, CASE WHEN max(source_time_updated) % 3 = 0 THEN 'error' WHEN max(source_time_updated) % 3 = 1 THEN 'running' ELSE 'idle' END AS state, max(time_completed_utc) AS last_success, count(*) AS n FROM {usage} GROUP BY 1, 2"


@query(f", h AS ({HOSTS.format(usage='usage_record')}), s AS ({SLOTS.format(usage='usage_record')}), g AS (SELECT host_id, max(last_success) AS last_success, count(*) AS slots, CASE WHEN bool_or(state = 'error') THEN 'error' WHEN bool_or(state = 'running') THEN 'running' ELSE 'idle' END AS state FROM s GROUP BY 1) SELECT h.host_id, coalesce(g.last_success, 5) AS last_success, coalesce(slots, 0) AS slots, coalesce(g.state, 'unknown') AS state FROM h LEFT JOIN g USING (host_id)")
def host_status(spark, sf):
    statuses = spark.sql(SLOTS.format(usage="{u}"), u=I.usage(spark, sf))
    rows = H.with_status(hosts(spark, sf).withColumn("last_success", F.lit(5).cast("bigint")), statuses)
    return rows.select("host_id", "last_success", F.size("statuses").cast("bigint").alias("slots"), "state")


@query(f", s AS ({SLOTS.format(usage='usage_record')}), d AS (SELECT host_id, source, CASE WHEN state = 'idle' THEN NULL ELSE last_success + greatest(60000, n * 10) END AS next_due, state <> 'idle' AND coalesce(last_success + greatest(60000, n * 10) <= {NOW}, true) AS due FROM s) SELECT * FROM d")
def schedule(spark, sf):
    slots = spark.sql(SLOTS.format(usage="{u}"), u=I.usage(spark, sf))
    runs = slots.select("host_id", "source", F.when(F.col("state") == "idle", "manual").otherwise("timer").alias("trigger"), F.lit(60000).alias("min_interval_ms"), F.lit(10).alias("multiplier"), F.col("last_success").alias("last_completed"), F.col("n").alias("last_duration_ms"))
    return H.next_due(runs, NOW).select("host_id", "source", "next_due", "due")


# ---- incremental


@query("SELECT host_id, source, message_id, origin_priority, source_time_updated, tok_input, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY host_id, source, message_id ORDER BY origin_priority DESC, source_time_updated DESC, arrival_seq DESC) AS n FROM arrivals) x WHERE n = 1")
def upsert_winner(spark, sf):
    return M.winners(I.arrivals(I.usage(spark, sf)), "host_id", "source", "message_id")


@query("""SELECT host_id, source, message_id, (m).t AS time_created_utc, (m).u AS source_time_updated, (m).i AS tok_input FROM (
SELECT host_id, source, message_id, arg_max({'t': time_created_utc + r * 7776000000, 'u': source_time_updated + r, 'i': tok_input + r}, r) AS m FROM usage_record JOIN (SELECT unnest([0, 1, 2]) AS r) n
 ON r = 0 OR r = 1 AND time_created_utc % 3 = 0 OR r = 2 AND time_created_utc % 5 = 0 GROUP BY 1, 2, 3) x""")
def archive_rounds(spark, sf):
    """Three rounds into an archive: records are told again, created three and six months later."""
    folder, rows = f"{A.scratch(spark)}/archive-{uuid.uuid4().hex}", I.usage(spark, sf)
    for r, chosen in enumerate(("true", "time_created_utc % 3 = 0", "time_created_utc % 5 = 0")):
        A.publish(rows.where(chosen).withColumns({"time_created_utc": F.col("time_created_utc") + r * 7_776_000_000, "source_time_updated": F.col("source_time_updated") + r, "tok_input": F.col("tok_input") + r}), folder, r)
    return A.archive(spark, folder).select("host_id", "source", "message_id", "time_created_utc", "source_time_updated", "tok_input")


def rolled_archive(spark, sf):
    """An archive of two rounds whose aggregates are of the first: the second tells a part of the records again."""
    folder, rows = f"{A.scratch(spark)}/archive-{uuid.uuid4().hex}", I.usage(spark, sf)
    A.publish(rows, folder, 0)
    rollup.refresh(spark, folder)
    A.publish(rows.where("source = 'codex'").withColumns({"source_time_updated": F.col("source_time_updated") + 1, "session_id": F.concat("session_id", F.lit("-again"))}), folder, 1)
    return folder


AGAIN = ", usage_again AS (SELECT * REPLACE (CASE WHEN source = 'codex' THEN session_id || '-again' ELSE session_id END AS session_id) FROM usage_record) "


@query(AGAIN + f"SELECT {SUMS}, {COUNTS}, count(DISTINCT session_id) AS sessions FROM usage_again WHERE NOT is_incomplete AND {range_sql(MARCH)}")
def rolled_summary(spark, sf):
    return rollup.summary(spark, rolled_archive(spark, sf), MARCH)


@query(AGAIN + f"SELECT source, agent_key, provider_id, model_id, variant, {BREAK} FROM usage_again WHERE NOT is_incomplete AND {range_sql(MARCH)} GROUP BY 1, 2, 3, 4, 5")
def rolled_breakdown(spark, sf):
    folder = rolled_archive(spark, sf)
    rollup.refresh(spark, folder)
    return rollup.breakdown(spark, folder, MARCH, by_variant=True)


@query(ORACLE_SQL["trend_costs"].removeprefix(I.WITH))
def rolled_costs(spark, sf):
    return rollup.trend_costs(spark, rolled_archive(spark, sf), I.catalog(spark), MARCH, "day")


@query("SELECT origin_priority, count(*) FILTER (changed) AS changed, count(*) AS arrived FROM (SELECT *, coalesce(origin_priority * 10000000000000 + source_time_updated >= max(origin_priority * 10000000000000 + source_time_updated) OVER (PARTITION BY host_id, source, message_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS changed FROM arrivals) x GROUP BY 1")
def upsert_changed(spark, sf):
    rows = M.changed(I.arrivals(I.usage(spark, sf)), "host_id", "source", "message_id")
    return rows.groupBy("origin_priority").agg(F.count_if("changed").alias("changed"), F.count("*").alias("arrived"))


@query("SELECT host_id, source, max(source_time_updated) AS cursor FROM usage_record WHERE origin = 'live' GROUP BY 1, 2")
def cursor_state(spark, sf):
    return M.cursors(I.usage(spark, sf))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_tax FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag <> 'R' DESC, l_quantity DESC, l_tax DESC, l_returnflag DESC) AS n FROM lineitem) x WHERE n = 1", usage=False)
def dedup_winner(spark, sf):
    from ..sources import transcripts as S

    rows = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax")
    return S.winners(rows, ["l_orderkey", "l_linenumber"], F.col("l_returnflag") != "R", F.col("l_quantity"), F.col("l_tax"), F.col("l_returnflag"))


CONV = "SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::bigint - CASE WHEN conv_id % 13 = 0 AND turn % 3 = 2 THEN 500 ELSE 0 END AS total FROM conversations"


def conversation_totals(spark, sf):
    rows = I.table(spark, sf, "conversations")
    return spark.sql(CONV.replace("::bigint", "").replace("FROM conversations", "FROM {c}").replace("ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"), c=rows)


@query(f"WITH c AS ({CONV}), l AS (SELECT *, coalesce(lag(total) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS before FROM c) SELECT conv_id, turn, total, greatest(total - before, 0)::bigint AS delta, total < before AS regressed FROM l", usage=False)
def cumulative_delta(spark, sf):
    return M.deltas(conversation_totals(spark, sf), ["conv_id"], "turn", "total").select("conv_id", "turn", "total", "delta", "regressed")


# a conversation as a rollout: what is said of session and model, and totals, of which every fourth states its gain
ROLLOUTS = f"""c AS (SELECT conv_id, turn, greatest(total, 0) AS total FROM ({CONV}) t),
w AS (SELECT *, coalesce(lag(total) OVER o, 0) AS before, coalesce(bool_or(turn = 0) OVER (o ROWS UNBOUNDED PRECEDING), false) AS met, last_value(CASE WHEN turn % 5 = 0 THEN turn END IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING) AS named FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, total > before AND turn % 4 = 1 AS stated FROM w),
rollout AS (SELECT 'c' || conv_id || '.jsonl#' || (turn * 3 + 3) AS message_id, CASE WHEN met THEN 's' ELSE 'c' END || conv_id AS session_id, 1782864000000 AS time_created_utc,
 CASE WHEN named % 10 = 0 THEN 'ns' WHEN met THEN 'prov' ELSE 'codex' END AS provider_id, CASE WHEN named IS NULL THEN 'unknown' WHEN named % 10 = 0 THEN 'm' || named ELSE 'plain' || named END AS model_id, CASE WHEN named IS NULL THEN '' ELSE '/w/' || named END AS project_dir,
 {", ".join(f"(CASE WHEN stated THEN {stated} ELSE greatest(total // {d} - before // {d}, 0) END)::BIGINT AS tok_{k}" for k, d, stated in (("input", 1, 1), ("cache_read", 2, 0), ("cache_write", 5, 0), ("output", 3, 2), ("reasoning", 7, 0)))}, total < before AS regressed FROM k)"""


def rollout_lines(spark, sf):
    """(path, line, value): three lines a turn, the first two of which may be missing."""
    t = conversation_totals(spark, sf).selectExpr("conv_id", "turn", "greatest(total, 0) AS total")
    last = "CASE WHEN turn % 4 = 1 THEN ',\"last_token_usage\":{\"input_tokens\":1,\"output_tokens\":2}' ELSE '' END"
    each = ",".join(f"\"{name}\":' || cast(total div {d} as string) || '" for name, d in (("input_tokens", 1), ("cached_input_tokens", 2), ("cache_write_input_tokens", 5), ("output_tokens", 3), ("reasoning_output_tokens", 7), ("total_tokens", 1)))
    model = "CASE WHEN turn % 10 = 0 THEN 'ns.m' ELSE 'plain' END || cast(turn as string)"
    values = (
        "CASE WHEN turn % 5 = 0 THEN '{\"type\":\"turn_context\",\"payload\":{\"model\":\"' || " + model + " || '\",\"cwd\":\"/w/' || cast(turn as string) || '\"}}' END",
        "CASE WHEN turn = 0 THEN '{\"type\":\"session_meta\",\"payload\":{\"id\":\"s' || cast(conv_id as string) || '\",\"model_provider\":\"prov\"}}' END",
        "'{\"timestamp\":\"2026-07-01T00:00:00Z\",\"type\":\"event_msg\",\"payload\":{\"type\":\"token_count\",\"info\":{\"total_token_usage\":{" + each + "}' || " + last + " || '}}}'",
    )
    rows = t.select("conv_id", "turn", F.posexplode(F.array(*(F.expr(v) for v in values))).alias("nth", "value")).where("value is not null")
    return rows.select(F.expr("'c' || cast(conv_id as string) || '.jsonl'").alias("path"), F.expr("turn * 3 + nth + 1").cast("bigint").alias("line"), "value")


@query(f"WITH {ROLLOUTS} SELECT message_id, session_id, time_created_utc, provider_id, model_id, project_dir, tok_input, tok_cache_read, tok_cache_write, tok_output, tok_reasoning, regressed, tok_input + tok_output + tok_cache_read + tok_cache_write = 0 AS is_incomplete FROM rollout", usage=False)
def norm_rollouts(spark, sf):
    from ..sources import lines as L
    from ..sources import rollouts as S

    return S.records(L.parsed(rollout_lines(spark, sf))).drop("path", "line")


_MEASURES = "count(*) AS n, count(DISTINCT session_id) AS sessions, sum(tok_input)::BIGINT AS tok_input, sum(tok_output)::BIGINT AS tok_output, sum(tok_reasoning)::BIGINT AS tok_reasoning, sum(tok_cache_read)::BIGINT AS tok_cache_read, sum(tok_cache_write)::BIGINT AS tok_cache_write, min(time_created_utc) AS first_created, max(source_time_updated) AS last_updated"


@query(
    f"""WITH {ROLLOUTS}, m AS (SELECT event_id % 11 AS k, * FROM events WHERE event_id % 11 NOT IN (0, 1, 2, 5)),
l AS (SELECT event_id // 3 AS answer, 'f' || (event_id % 7) AS path, event_id AS line, epoch_us(ts) // 1000 AS ms, user_id, event_id % 4 = 0 AS side, event_id % 100 AS i, event_id % 13 AS o, CASE WHEN event_id % 2 = 0 THEN 5 ELSE 7 END AS w, event_id % 5 = 0 AS fast FROM events WHERE event_id % 11 <> 10),
t AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY side, i + o + 5 + w DESC, fast DESC, path, line) AS nth FROM l),
s AS (SELECT user_id AS id, min(epoch_us(ts)) / 1e6 AS first_at, max(epoch_us(ts)) / 1e6 AS last_at, count(*) AS n, sum(floor(value))::BIGINT - 1500 AS tok FROM events GROUP BY 1),
u AS (SELECT 'opencode' AS source, 'message' AS granularity, 'ses-' || user_id AS session_id, CASE WHEN k = 4 THEN 0 ELSE event_id END AS tok_input, 0 AS tok_output, CASE WHEN k IN (3, 4) THEN 0 ELSE 2 END AS tok_reasoning, CASE WHEN k IN (3, 4) THEN 0 ELSE 7 END AS tok_cache_read, 0 AS tok_cache_write, epoch_us(ts) // 1000 AS time_created_utc, epoch_us(ts) // 1000 + 9 AS source_time_updated FROM m
 UNION ALL SELECT 'claude-code', 'message', 's' || user_id, i, o, 0, 5, w, ms, ms FROM t WHERE nth = 1
 UNION ALL SELECT 'codex', 'message', session_id, tok_input, tok_output, tok_reasoning, tok_cache_read, tok_cache_write, time_created_utc, time_created_utc FROM rollout
 UNION ALL SELECT 'hermes', 'session', id::VARCHAR, tok, n * 3, n, n * 2, n, floor(first_at * 1000)::BIGINT, floor(CASE WHEN id % 7 <> 0 THEN last_at ELSE first_at END * 1000)::BIGINT FROM s WHERE tok >= 0)
SELECT source, granularity, {_MEASURES} FROM u GROUP BY 1, 2""",
    usage=False,
)
def union_sources(spark, sf):
    """Four exports, each read by its own adapter, as one fact."""
    from ..sources import adapters, sessions

    events = I.table(spark, sf, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    exports = {
        "messages": events.select(F.expr("'msg-' || cast(event_id as string)").alias("id"), F.expr("'ses-' || cast(user_id as string)").alias("session_id"), ms.alias("time_created"), (ms + 9).alias("time_updated"), F.expr(RAW.replace("varchar", "string")).alias("data")),
        "transcripts": transcript_lines(spark, sf), "rollouts": rollout_lines(spark, sf), "sessions": sessions.with_activity(*sessions.from_events(events)),
    }
    facts, _ = adapters.adapted(exports, "host")
    return facts.groupBy("source", "granularity").agg(
        F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), *(F.sum(f"tok_{k}").alias(f"tok_{k}") for k in ("input", "output", "reasoning", "cache_read", "cache_write")),
        F.min("time_created_utc").alias("first_created"), F.max("source_time_updated").alias("last_updated"),
    )


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'system' OR turn % 5 = 0 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS model FROM conversations", usage=False)
def carry_forward(spark, sf):
    rows = I.table(spark, sf, "conversations").withColumn("model", F.expr("case when role = 'system' or turn % 5 = 0 then role || turn end"))
    return M.carried(rows, ["conv_id"], "turn", "model").select("conv_id", "turn", "model")


@query("WITH f AS (SELECT 'live' AS origin, p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'bak', p_partkey, p_name FROM part WHERE p_partkey % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE origin WHEN 'live' THEN 0 ELSE 1 END) AS n FROM f) SELECT origin, count(*) FILTER (n = 1) AS kept, count(*) FILTER (n > 1) AS shadowed FROM r GROUP BY 1", usage=False)
def shadow_dedup(spark, sf):
    from ..sources import rollouts as S

    part = I.table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".jsonl")).alias("path"), "p_partkey")
    trees = part.where("p_partkey % 3 <> 0").withColumn("origin", F.lit("live")).unionByName(part.where("p_partkey % 2 = 0").withColumn("origin", F.lit("bak")))
    return S.shadowed(trees).groupBy("origin").agg(F.count_if(~F.col("shadowed")).alias("kept"), F.count_if("shadowed").alias("shadowed"))


@query("SELECT o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0) n USING (o_orderkey)", usage=False)
def kv_merge(spark, sf):
    orders = I.table(spark, sf, "orders")
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"))
    return M.merged_values(orders.where("o_orderkey % 3 <> 0"), new, "o_orderkey", "o_totalprice")


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 5 = 1 GROUP BY 1) SELECT sum(a.n)::bigint AS archived, sum(b.n)::bigint AS listed, count(a.k) AS archived_keys, count(b.k) AS listed_keys, count(*) FILTER (a.k IS NULL) AS missing, count(*) FILTER (b.k IS NULL) AS unlisted, false AS equal FROM a FULL JOIN b USING (k)", usage=False)
def reconcile_counts(spark, sf):
    orders = I.table(spark, sf, "orders")
    return M.reconciled(orders.where("o_orderkey % 5 = 0"), orders.where("o_orderkey % 5 = 1"), "o_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 5 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 1", usage=False)
def reconcile_diff(spark, sf):
    orders = I.table(spark, sf, "orders")
    return M.missing(orders.where("o_orderkey % 5 = 0"), orders.where("o_orderkey % 5 = 1"), "o_custkey")
