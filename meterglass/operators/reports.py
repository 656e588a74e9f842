"""Reports over the usage fact: summaries, trends, breakdowns, drilldowns and pages of detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import exprs as X
from ..schema import TOKENS
from . import coverage as K
from . import pricing as P

#: Grouping sets of the trend bundle beside the total.
DIMENSIONS = {"source": ("source",), "agent": ("agent_key",), "provider": ("provider_id",), "model": ("provider_id", "model_id")}
MOST_PER_PAGE = 200
PRESETS = ("today", "last_7", "last_30", "quarter", "year")


def filtered(usage: DataFrame, span: C.LocalRange | None = None, complete: bool | None = True, **equal: str | None) -> DataFrame:
    """Rows of the range that are complete (None: all) and equal in each named column that isn't None."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    if span is not None:
        tests.append(C.in_range(F.col("time_created_utc"), span))
    if complete is not None:
        tests.append(F.col("is_incomplete") != complete)
    return usage.where(reduce(lambda a, b: a & b, tests)) if tests else usage


def measures() -> list[Column]:
    """Sums of the five token counters and the counts of message and session records, which are never added up."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS]
    return [*sums, F.count_if(F.col("granularity") == "message").alias("messages"), F.count_if(F.col("granularity") == "session").alias("session_records")]


def summary(usage: DataFrame) -> DataFrame:
    """One row, zeros for no records. Sessions are counted exactly; they don't add up over parts."""
    return usage.agg(*measures(), F.count_distinct("session_id").alias("sessions"))


def breakdown(usage: DataFrame, by_variant: bool = False) -> DataFrame:
    """Measures by source, agent, model and, if asked for, variant. Rows come in no order; a page sorts its own."""
    keys = ["source", "agent_key", "provider_id", "model_id"]
    variant = F.col("variant") if by_variant else F.lit(None).cast("string")
    return usage.withColumn("variant", variant).groupBy(*keys, "variant").agg(*measures(), F.count_distinct("session_id").alias("sessions"), F.max("agent_raw").alias("agent_label"))


def breakdown_costs(priced: DataFrame, by_variant: bool = False) -> DataFrame:
    """The breakdown of priced records with costs by layer: prices are known per row, so nothing is joined afterwards."""
    variant = F.col("variant") if by_variant else F.lit(None).cast("string")
    rows = priced.withColumn("variant", variant).groupBy("source", "agent_key", "provider_id", "model_id", "variant")
    return rows.agg(*measures(), F.count_distinct("session_id").alias("sessions"), F.max("agent_raw").alias("agent_label"), *P.in_series())


def trend(usage: DataFrame, span: C.LocalRange, unit: str, *by: str, extra: list[Column] | None = None) -> DataFrame:
    """(bucket_start, by, measures) of the buckets with records: one aggregation by a key that each row has itself."""
    start = C.bucket_start(F.col("time_created_utc"), unit, span)
    return usage.withColumn("bucket_start", start).groupBy("bucket_start", *by).agg(*measures(), *(extra or []))


def dense(spine: DataFrame, series: DataFrame, *values: str) -> DataFrame:
    """Every bucket of the spine, with zeros where nothing happened."""
    return spine.join(series, "bucket_start", "left").na.fill(0, list(values))


#: Bits of grouping_id over source, agent, provider and model, from the high one down; a set bit is rolled up.
LEVELS = {0b1111: "total", 0b0111: "source", 0b1011: "agent", 0b1101: "provider", 0b1100: "model"}


def rolled_up(base: DataFrame, *sums: Column) -> DataFrame:
    """(bucket_start, dimension, id, id2, sums): total and four dimensions of an aggregate by bucket and all of them."""
    columns = {k: F.col(k) for k in ("bucket_start", "source", "agent_key", "provider_id", "model_id")}
    sets = [[columns["bucket_start"], *(columns[c] for c in extra)] for extra in ((), *DIMENSIONS.values())]
    rows = base.groupingSets(sets, *columns.values()).agg(*sums, F.grouping_id().alias("_g"))
    level = F.element_at(F.create_map(*(F.lit(v) for pair in LEVELS.items() for v in pair)), F.col("_g").cast("int"))
    rows = rows.withColumns({"dimension": level, "id": F.coalesce("source", "agent_key", "provider_id", F.lit(""))})
    rows = rows.withColumn("id2", F.coalesce(F.when(F.col("dimension") == "model", F.col("model_id")), F.lit("")))
    return rows.drop("_g", "source", "agent_key", "provider_id", "model_id")


def trend_bundle(usage: DataFrame, span: C.LocalRange, unit: str) -> DataFrame:
    """(bucket_start, dimension, id, id2, tokens, messages): total and four dimensions from one scan and one aggregation."""
    start = C.bucket_start(F.col("time_created_utc"), unit, span)
    base = usage.withColumn("bucket_start", start).groupBy("bucket_start", "source", "agent_key", "provider_id", "model_id").agg(F.sum(X.all_tokens()).alias("tokens"), F.count_if(F.col("granularity") == "message").alias("messages"))
    return rolled_up(base, F.sum("tokens").alias("tokens"), F.sum("messages").alias("messages")).select("bucket_start", "dimension", "id", "id2", "tokens", "messages")


def trend_costs(usage: DataFrame, catalog: DataFrame, span: C.LocalRange, unit: str, overrides: DataFrame | None = None) -> DataFrame:
    """The bundle with all measures, costs by layer and, for agents, a label: one scan, one aggregation of records."""
    start = C.bucket_start(F.col("time_created_utc"), unit, span)
    counts = [F.count_if(F.col("granularity") == g).alias(c) for g, c in (("message", "messages"), ("session", "session_records"))]
    groups = P.folded(usage.withColumn("bucket_start", start), "bucket_start", "source", "agent_key", extra=[*counts, F.max("agent_raw").alias("label")])
    return costs_of_groups(groups, catalog, overrides)


def costs_of_groups(groups: DataFrame, catalog: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The costs bundle of `pricing.folded` rows that have bucket_start, source, agent_key, the two record counts and label."""
    rows = P.priced(groups, P.match(groups, catalog, overrides))
    keys = ["bucket_start", "source", "agent_key", "provider_id", "model_id"]
    sums = [F.sum(c).alias(c) for c in (*TOKENS, "messages", "session_records")]
    base = rows.groupBy(*keys).agg(*sums, *P.in_series(None, F.col("records")), F.max("label").alias("label"))
    sums += [F.round(F.sum(c), 9).alias(c) if c.endswith("_sum") else F.sum(c).alias(c) for c in P.COSTS]
    out = rolled_up(base, *sums, F.max("label").alias("label"))
    return out.withColumn("label", F.when(F.col("dimension") == "agent", F.col("label")))


def top_groups(series: DataFrame, n: int = 6) -> DataFrame:
    """(bucket_start, id, tokens): the n heaviest groups, and what remains of the total of each bucket as `other`."""
    weight = series.groupBy("id").agg(F.sum("tokens").alias("w")).where("w > 0")
    kept = weight.orderBy(F.desc("w"), "id").limit(n).select("id", F.lit(True).alias("kept"))
    rows = series.join(F.broadcast(kept), "id", "left").withColumn("id", F.when(F.col("kept"), F.col("id")).otherwise("other"))
    return rows.groupBy("bucket_start", "id").agg(F.sum("tokens").alias("tokens"))


def presets(usage: DataFrame, zone: str, now_ms: int) -> DataFrame:
    """(preset, tokens, messages) for ranges up to today, in one scan."""
    today = C.local_date(F.lit(now_ms), zone)
    first = {"today": today, "last_7": F.date_sub(today, 6), "last_30": F.date_sub(today, 29), "quarter": F.trunc(today, "quarter"), "year": F.trunc(today, "year")}
    end = C.day_start(F.date_add(today, 1), zone)
    t = F.col("time_created_utc")
    inside = F.filter(F.array(*(F.when((t >= C.day_start(first[p], zone)) & (t < end), F.lit(p)) for p in PRESETS)), lambda p: p.isNotNull())
    return usage.withColumn("preset", F.explode(inside)).groupBy("preset").agg(F.sum(X.all_tokens()).alias("tokens"), F.count("*").alias("records"))


def cost_tiers(costs: DataFrame) -> DataFrame:
    """(layer, amount, tokens, share, per_mtok) of a row of costs: share of billable tokens and price of a million."""
    whole = F.col("actual_tokens") + F.col("estimated_tokens") + F.col("unavailable_tokens")
    layers = [F.struct(F.lit(x).alias("layer"), (F.col(f"{x}_sum") if x != "unavailable" else F.lit(None).cast("double")).alias("amount"), F.col(f"{x}_tokens").alias("tokens")) for x in ("actual", "estimated", "unavailable")]
    rows = costs.select(whole.alias("whole"), F.explode(F.array(*layers)).alias("x")).select("x.*", "whole")
    share = F.when(F.col("whole") > 0, F.round(F.col("tokens") / F.col("whole"), 6))
    return rows.select("layer", "amount", "tokens", share.alias("share"), F.when(F.col("tokens") > 0, F.round(F.col("amount") / F.col("tokens") * 1e6, 6)).alias("per_mtok"))


def missing_prices(priced: DataFrame) -> DataFrame:
    """(provider_id, model_id, records): billable rows that have no price, by model."""
    return priced.where(X.is_billable() & (F.col("layer") == "unavailable")).groupBy("provider_id", "model_id").agg(F.count("*").alias("records"))


def observed_models(usage: DataFrame, matches: DataFrame) -> DataFrame:
    """(provider_id, model_id, records, kind) of all billable records, complete or not."""
    return usage.where(X.is_billable()).groupBy("provider_id", "model_id").agg(F.count("*").alias("records")).join(matches.select("provider_id", "model_id", "kind"), ["provider_id", "model_id"])


def observed_classes(observed: DataFrame) -> DataFrame:
    """(class, place, provider_id, model_id, records): how sure the price is, ranked by use; exact ones are left out."""
    kind = F.when(F.col("kind") == P.UNKNOWN, "unknown").when(F.col("kind") == P.CROSS, "inferred").when(F.col("kind") != P.EXACT, "approximate")
    rows = observed.withColumn("class", kind).where("class is not null")
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("records"), "provider_id", "model_id"))
    return rows.select("class", place.alias("place"), "provider_id", "model_id", "records")


def provider_rank(observed: DataFrame, *others: DataFrame) -> DataFrame:
    """(place, provider_id, records): observed providers by use, then those that only others (catalog, saved prices) have."""
    seen = observed.groupBy("provider_id").agg(F.sum("records").alias("records"))
    unused = [o.select("provider_id", F.lit(0).cast("bigint").alias("records")) for o in others]
    rows = reduce(DataFrame.unionByName, unused, seen).groupBy("provider_id").agg(F.sum("records").alias("records"))
    place = F.row_number().over(Window.orderBy(F.desc("records"), "provider_id"))  # as many rows as providers
    return rows.select(place.alias("place"), "provider_id", "records")


def drill(usage: DataFrame, level: str) -> DataFrame:
    """Level source, agent or model: token sums with each node's share of its level; `by_weight` puts the heaviest first."""
    keys = {"source": ["source"], "agent": ["source", "agent_key"], "model": ["source", "agent_key", "provider_id", "model_id"]}[level]
    extra = {"source": [F.count_distinct("agent_key").alias("agents")], "agent": [F.count_distinct("provider_id", "model_id").alias("models"), F.max_by("agent_raw", F.struct("provider_id", "model_id", F.coalesce("variant", F.lit("")), "agent_raw")).alias("agent_label")], "model": [F.count_distinct(F.coalesce("variant", F.lit(""))).alias("variants")]}[level]
    rows = usage.groupBy(*keys).agg(F.sum(X.all_tokens()).alias("tokens"), F.count("*").alias("records"), *extra)
    whole = F.sum("tokens").over(Window.partitionBy(*(keys[:-1] if level == "agent" else keys[:2] if level == "model" else [F.lit(1)])))
    return rows.withColumn("share", F.when(whole > 0, F.round(F.col("tokens") / whole, 6)).otherwise(0.0))


def by_weight(nodes: DataFrame, *ids: str) -> DataFrame:
    """Nodes of a drilldown, heaviest first, equal ones by id. A level has as many rows as a screen shows."""
    return nodes.orderBy(F.desc("tokens"), *ids)


def models_like(usage: DataFrame, needle: str) -> DataFrame:
    """(provider_id, model_id) of the pairs that have the needle in one of the two, in whatever case."""
    low = needle.lower()
    return usage.select("provider_id", "model_id").distinct().where(F.lower("provider_id").contains(low) | F.lower("model_id").contains(low))


def variants(usage: DataFrame) -> DataFrame:
    """Models of each agent with their variants nested, heaviest first: (id, tokens, records); no variant has the id ''."""
    keys = ["source", "agent_key", "provider_id", "model_id"]
    each = usage.groupBy(*keys, F.coalesce("variant", F.lit("")).alias("id")).agg(F.sum(X.all_tokens()).alias("tokens"), F.count("*").alias("records"))
    nested = F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("w"), "id", "tokens", "records")))
    rows = each.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.sum("records").alias("records"), nested.alias("variants"))
    return rows.withColumn("variants", F.transform("variants", lambda v: v.dropFields("w")))


def detail_costs(page: DataFrame, matches: DataFrame) -> DataFrame:
    """A page of records with what each cost: actual, or estimated, or neither and unavailable."""
    rows = P.priced(page, matches)
    return rows.select(*page.columns, *(F.when(F.col("layer") == x, F.col("amount")).alias(x) for x in ("actual", "estimated")), (F.col("layer") == "unavailable").alias("unavailable"))


def detail(usage: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of records, newest first. The order is total, so pages neither overlap nor miss rows."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    order = [F.desc("time_created_utc"), F.asc("message_id"), F.asc("host_id"), F.asc("source")]
    return usage.orderBy(*order).offset(offset).limit(min(limit, MOST_PER_PAGE))


#: The order of pages, newest first: total, as a message's identifier is unique in its host and source.
PAGED = ("message_id", "host_id", "source")


def detail_after(usage: DataFrame, limit: int, after: tuple[int, str, str, str] | None = None) -> DataFrame:
    """The page of records that follows the one whose (time_created_utc, *PAGED) are `after`; the first page without it.

    What comes before isn't sorted or counted, as an offset's would be, and the time's bound reaches the scan.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    if after is not None:
        time, rest = F.col("time_created_utc"), F.struct(*(F.lit(x).alias(c) for c, x in zip(PAGED, after[1:], strict=True)))
        usage = usage.where(time <= after[0]).where((time < after[0]) | (F.struct(*PAGED) > rest))
    return usage.orderBy(F.desc("time_created_utc"), *PAGED).limit(min(limit, MOST_PER_PAGE))


def masked_trend(usage: DataFrame, intervals: DataFrame, spine: DataFrame, span: C.LocalRange, unit: str) -> DataFrame:
    """Every bucket with coverage and tokens; null where nothing was scanned."""
    rows = trend(usage, span, unit).withColumn("tokens", X.all_tokens()).select("bucket_start", "tokens")
    return K.masked(K.status(spine, intervals).join(rows, "bucket_start", "left"), "tokens")


def daily(usage: DataFrame, zone: str) -> DataFrame:
    """Per local day: sums over complete rows, and how many incomplete ones there are."""
    done = ~F.col("is_incomplete")
    sums = [F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c) for c in TOKENS]
    cost = F.round(F.coalesce(F.sum(F.when(done & X.is_trusted(), F.col("cost"))), F.lit(0.0)), 6).alias("cost")
    return usage.groupBy(C.local_date(F.col("time_created_utc"), zone).alias("day")).agg(*sums, cost, F.count_if(done).alias("records"), F.count_distinct(F.when(done, F.col("session_id"))).alias("sessions"), F.count_if(~done).alias("incomplete"))
