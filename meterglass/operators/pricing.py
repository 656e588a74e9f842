"""Prices for models: a cascade of ever looser matches, and what a record costs by its price."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import BILLABLE, PRICES, TOKENS

EXACT, NORMALIZED, FAMILY, CROSS, UNKNOWN = "exact", "normalized", "family", "crossProvider", "unknown"
MAKERS = ("anthropic", "google", "openai")


class InvalidPrices(ValueError):
    """A price document that breaks a rule."""


def identities(df: DataFrame) -> DataFrame:
    """Adds the normalised provider (np) and model (nm), its family (nf) and version (nv), and the priced model (pm, pf, pv)."""
    df = df.withColumns({"np": X.provider(F.col("provider_id")), "nm": X.model(F.col("model_id"))})
    df = df.withColumns({"nf": X.family(F.col("nm")), "nv": X.version(F.col("nm")), "pm": X.priced_model(F.col("nm"))})
    return df.withColumns({"pf": X.family(F.col("pm")), "pv": X.version(F.col("pm"))})


def match(pairs: DataFrame, catalog: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(provider_id, model_id, kind, prices) of each pair; prices are null where nothing matches.

    catalog: catalog_ord, provider_id, model_id and prices. An override of the very pair wins; then, in order: the
    pair as it is; the same provider and model once normalised; the nearest version of the model's family; the model
    without its effort suffix; and, for providers that the catalog doesn't have, the same model and then family of
    any provider. All layers are one equality join on the distinct pairs, and the first layer's first candidate stays.
    """
    asked = identities(pairs.select("provider_id", "model_id").distinct())
    there = identities(catalog)
    there = there.select(*(F.col(c).alias(f"c_{c}") for c in there.columns))
    known = there.select(F.col("c_np").alias("np")).distinct().withColumn("listed", F.lit(True))
    asked = asked.join(known, "np", "left")
    rank = F.when(F.col("c_np").isin(*MAKERS), 0).when(F.col("c_np") == "amazon-bedrock", 1).otherwise(2)
    order, name = F.col("c_catalog_ord"), F.col("c_model_id")
    pad = lambda x: F.lpad(x.cast("string"), 12, "0")
    near = pad(X.family_distance(F.col("nv"), F.col("c_nv")))
    near_priced = pad(X.family_distance(F.col("pv"), F.col("c_nv")))
    older = pad(F.lit(99_999_999) - F.coalesce("c_nv", F.lit(-1)))
    # what must be equal on either side, the kind of match, and which candidate comes first
    layers = (
        (("provider_id", "model_id"), ("provider_id", "model_id"), EXACT, [pad(order)]),
        (("np", "nm"), ("np", "nm"), NORMALIZED, [pad(order)]),
        (("np", "nf"), ("np", "nf"), FAMILY, [near, older, name]),
        (("np", "pm"), ("np", "nm"), CROSS, [pad(order)]),
        (("pm",), ("pm",), CROSS, [pad(rank), F.col("c_np"), name]),
        (("pf",), ("pf",), CROSS, [near_priced, older, pad(rank), F.col("c_np"), name]),
    )

    def keyed(df: DataFrame, side: int, prefix: str) -> DataFrame:
        """One row a layer: all layers are then one equality join."""
        keys = [F.struct(F.lit(i).alias("layer"), F.concat(*(F.concat(F.col(prefix + c), F.lit("\0")) for c in layer[side])).alias("key")) for i, layer in enumerate(layers)]
        return df.select("*", F.explode(F.array(*keys)).alias("k")).select("*", "k.*").drop("k")

    found = keyed(asked, 0, "").where("layer < 4 or listed is null").join(keyed(there, 1, "c_"), ["layer", "key"])
    by, kind = F.array().cast("array<string>"), F.lit(UNKNOWN)
    for i, layer in enumerate(layers):
        by, kind = F.when(F.col("layer") == i, F.array(*layer[3])).otherwise(by), F.when(F.col("layer") == i, layer[2]).otherwise(kind)
    found = found.select("provider_id", "model_id", "layer", kind.alias("kind"), by.alias("by"), *(F.col(f"c_{p}").alias(p) for p in PRICES))
    first = F.row_number().over(Window.partitionBy("provider_id", "model_id").orderBy("layer", "by"))
    best = found.withColumn("n", first).where("n = 1").select("provider_id", "model_id", "kind", *PRICES)
    out = asked.select("provider_id", "model_id").join(best, ["provider_id", "model_id"], "left")
    if overrides is not None:
        own = overrides.select("provider_id", "model_id", *(F.col(p).alias(f"o_{p}") for p in PRICES), F.lit(True).alias("own"))
        out = out.join(own, ["provider_id", "model_id"], "left")
        out = out.withColumns({"kind": F.when(F.col("own"), EXACT).otherwise(F.col("kind"))} | {p: F.when(F.col("own"), F.col(f"o_{p}")).otherwise(F.col(p)) for p in PRICES})
    return out.select("provider_id", "model_id", F.coalesce("kind", F.lit(UNKNOWN)).alias("kind"), *PRICES)


def estimate() -> Column:
    """What the row's tokens cost by its prices; reasoning tokens are part of the output and not priced again."""
    return reduce(lambda a, b: a + b, [F.col(t) / F.lit(1e6) * F.col(p) for t, p in zip(BILLABLE, PRICES, strict=True)])


def priced(usage: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds kind, layer (actual, estimated, unavailable) and amount: own finite cost first, else by catalog, else none."""
    df = usage.join(matches, ["provider_id", "model_id"], "left")
    trusted, by_price = X.is_trusted() & F.col("cost_source").isin("actual", "estimated"), F.col(PRICES[0]).isNotNull()
    layer = F.when(trusted, F.col("cost_source")).when(by_price, "estimated").otherwise("unavailable")
    amount = F.when(trusted, F.col("cost")).when(by_price, estimate())
    return df.withColumns({"layer": layer, "amount": amount}).drop(*PRICES)


def folded(usage: DataFrame, *keys: str, extra: list[Column] | None = None, records: Column | None = None) -> DataFrame:
    """Records summed up by keys and by all that decides what they cost: records, the five counters and own cost.

    Estimates are linear in tokens, so `priced` gives groups what it gives their records together; prices then meet few
    rows, whatever the number of records. records: how many records a row stands for, if it is a group of them.
    """
    rows = usage.withColumns({"_trusted": X.is_trusted(), "_billed": X.is_billable()})
    sums = [F.sum(c).alias(c) for c in TOKENS]
    by = rows.groupBy(*keys, "provider_id", "model_id", "cost_source", "_trusted", "_billed")
    return by.agg((F.count("*") if records is None else F.sum(records)).alias("records"), *sums, F.sum(F.when(F.col("_trusted"), F.col("cost"))).alias("cost"), *(extra or [])).drop("_trusted", "_billed")


def cost_columns(counted: Column, paid: Column | None = None, digits: int | None = 6, records: Column | None = None) -> list[Column]:
    """Money by layer of the rows that are paid (None: those that count), and counts and billable tokens of those that count.

    records: how many records a row stands for, if it is a group of them.
    """
    paid, each = counted if paid is None else paid, F.lit(1) if records is None else records
    money = lambda x: F.coalesce(F.sum(F.when((F.col("layer") == x) & paid, F.col("amount"))), F.lit(0.0))
    out = [(money(x) if digits is None else F.round(money(x), digits)).alias(f"{x}_sum") for x in ("actual", "estimated")]
    for x in ("actual", "estimated", "unavailable"):
        here = (F.col("layer") == x) & counted
        out += [F.coalesce(F.sum(F.when(here, each)), F.lit(0)).alias(f"{x}_count"), F.coalesce(F.sum(F.when(here, X.billable())), F.lit(0)).alias(f"{x}_tokens")]
    return out


COSTS = ("actual_sum", "estimated_sum", *(f"{x}_{k}" for x in ("actual", "estimated", "unavailable") for k in ("count", "tokens")))


def in_series(digits: int | None = 9, records: Column | None = None) -> list[Column]:
    """Cost columns of a bucket or group: all money there is, but only billable rows are counted."""
    return cost_columns(X.is_billable(), in_summary(), digits, records)


def summed_costs(usage: DataFrame, catalog: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row of costs by layer: one aggregation of the records, and prices for its groups."""
    groups = folded(usage)
    return priced(groups, match(groups, catalog, overrides)).agg(*cost_columns(in_summary(), records=F.col("records")))


def in_summary() -> Column:
    return X.is_trusted() | X.is_billable()


def checked_catalog(catalog: DataFrame) -> DataFrame:
    """catalog, if ids are there and distinct and prices finite and not negative; one pass says what is wrong."""
    bad_price = reduce(lambda a, b: a | b, [F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) == float("inf")) for p in PRICES])
    blank = (F.coalesce(F.trim("provider_id"), F.lit("")) == "") | (F.coalesce(F.trim("model_id"), F.lit("")) == "")
    seen = catalog.agg(F.count_if(bad_price).alias("prices"), F.count_if(blank).alias("ids"), (F.count("*") - F.count_distinct("provider_id", "model_id")).alias("pairs")).first()
    for what, n in seen.asDict().items():
        if n:
            raise InvalidPrices(f"{n} entries with bad or repeated {what}")
    return catalog
