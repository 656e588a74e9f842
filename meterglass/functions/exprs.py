"""Scalar expressions over identifiers, tokens, raw JSON values and times: columns in, columns out."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BILLABLE, TOKENS

# Provider aliases, prefixes and suffixes of model names that don't change what a model costs.
PROVIDER_ALIASES = {
    "aws": "amazon-bedrock", "aws-bedrock": "amazon-bedrock", "bedrock": "amazon-bedrock", "amazon-bedrock-runtime": "amazon-bedrock",
    "google-ai": "google", "google-generative-ai": "google", "gemini": "google", "vertex-ai": "google", "vertexai": "google",
}
REGION_PREFIX = r"^(us-gov|us|eu|apac|jp|au|global)\."
VENDOR_PREFIX = r"^(anthropic|openai|google)\."
REVISION = r"-v[0-9]+:[0-9]+$"
EFFORT_SUFFIX = "-(xhigh|high|medium|low|minimal|max|thinking|fast)$"
CLOUD_NAMESPACES = ("anthropic", "openai", "google", "mistral", "cohere", "meta")


def total(*names: str) -> Column:
    return reduce(add, map(F.col, names))


def all_tokens() -> Column:
    return total(*TOKENS)


def billable() -> Column:
    return total(*BILLABLE)


def total_input() -> Column:
    return total("tok_input", "tok_cache_read", "tok_cache_write")


def cache_tokens() -> Column:
    return total("tok_cache_read", "tok_cache_write")


def is_billable() -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) > 0 for c in BILLABLE])


def is_trusted() -> Column:
    """Rows with a finite cost of their own."""
    return F.coalesce(F.col("cost").isNotNull() & ~F.isnan("cost") & (F.abs("cost") < float("inf")), F.lit(False))


def agent_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)[\s-]+", "-"), F.lit("-")))


def identifier(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), F.lit("-"))


def provider(x: Column) -> Column:
    plain = identifier(x)
    alias = F.create_map(*(F.lit(v) for pair in PROVIDER_ALIASES.items() for v in pair))
    return F.coalesce(F.element_at(alias, plain), plain)


def model(x: Column) -> Column:
    """What a model is called without region, vendor and revision."""
    plain = F.replace(F.lower(F.trim(x)), F.lit("_"), F.lit("-"))
    for pattern in (REGION_PREFIX, VENDOR_PREFIX, REVISION):
        plain = F.regexp_replace(plain, pattern, "")
    return identifier(plain)


def family(identity: Column) -> Column:
    return F.regexp_replace(identity, "-[0-9]{8}$", "")


def version(identity: Column) -> Column:
    """The date at a model's end as a number, or null."""
    return F.regexp_extract(identity, "-([0-9]{8})$", 1).try_cast("bigint")


def priced_model(identity: Column) -> Column:
    """The identity without an effort suffix."""
    return model(F.regexp_replace(identity, EFFORT_SUFFIX, ""))


def family_distance(asked: Column, there: Column) -> Column:
    """How far a dated model is from another one of its family; both dated ones are nearest."""
    far = F.lit((1 << 32) - 1).cast("bigint")
    return F.when(asked.isNotNull() & there.isNotNull(), F.abs(asked - there)).when(there.isNotNull(), far - there).when(asked.isNotNull(), far - 1).otherwise(F.lit(0).cast("bigint"))


def host_id(machine: Column) -> Column:
    return F.substring(F.sha2(F.trim(machine), 256), 1, 16)


def number(text: Column) -> Column:
    """A finite double in text; null for anything else."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def cut_off(d: Column) -> Column:
    """A double as an integer without its fraction; null beyond the range and for no number."""
    return F.when(F.abs(d) < 9.2e18, d.try_cast("bigint"))


def whole_number(text: Column) -> Column:
    """An integer in text; fractions are cut off, null beyond the range."""
    return F.coalesce(F.trim(text).try_cast("bigint"), cut_off(F.trim(text).try_cast("double")))


def counter(text: Column) -> Column:
    """A count of tokens in text: never negative, 0 for what isn't a number."""
    return F.greatest(F.coalesce(whole_number(text), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def lossy_double(v: Column) -> Column:
    """A number or numeric string of a VARIANT as a finite double; null for anything else."""
    # truth values, objects and lists become text that is no number
    return number(F.try_variant_get(v, "$", "string"))


def lossy_bigint(v: Column) -> Column:
    """The same as an integer: fractions are cut off; null beyond the range."""
    return whole_number(F.try_variant_get(v, "$", "string"))


def lossy_count(v: Column) -> Column:
    """A count of tokens: never negative, 0 for what isn't a number."""
    return counter(F.try_variant_get(v, "$", "string"))


def text_or_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind.rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, "$", "string"))


def text_only(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds of an RFC 3339 time with offset, or of an integer in text; null for anything else."""
    whole = F.when(text.rlike("^-?[0-9]{1,18}$"), text.try_cast("bigint"))
    return F.coalesce(whole, F.when(text.rlike(RFC3339), F.unix_millis(F.try_to_timestamp(F.upper(text)))))


def seconds_to_ms(x: Column) -> Column:
    """Epoch seconds, with fraction, as milliseconds cut off; null if negative or not finite."""
    return F.when((x >= 0) & ~F.isnan(x) & (x < 9e15), F.floor(x * 1000).cast("bigint"))


def split_namespace(x: Column, fallback: str) -> Column:
    """(provider, model) of `namespace.model`."""
    ns, rest = F.regexp_extract(x, r"^([A-Za-z_-]+)\.(.*\S.*)$", 1), F.regexp_extract(x, r"^([A-Za-z_-]+)\.(.*\S.*)$", 2)
    blank = F.coalesce(F.trim(x), F.lit("")) == ""
    return F.when(blank, F.struct(F.lit(fallback).alias("provider"), F.lit("unknown").alias("model"))).when(ns != "", F.struct(ns.alias("provider"), rest.alias("model"))).otherwise(F.struct(F.lit(fallback).alias("provider"), x.alias("model")))


def billed_model(provider_: Column, base_url: Column, model_: Column, fallback: str) -> Column:
    """(provider, model) of a session that names who bills it.

    A cloud namespace before the model decides; then signs of a local model (the word in provider or address, its port,
    a custom space of that name, or a tag after a colon) give `ollama`; else the provider stands, or the fallback.
    """
    name = F.coalesce(F.nullif(F.trim(model_), F.lit("")), F.lit("unknown"))
    who, url = F.trim(F.coalesce(provider_, F.lit(""))), F.lower(F.coalesce(base_url, F.lit("")))
    cloud = r"^(?:global\.)?(" + "|".join(CLOUD_NAMESPACES) + r")\.(.*\S.*)$"
    custom = r"^(?i:custom):([^:]*):(.*\S.*)$"
    space = F.when(F.lower(F.regexp_extract(name, custom, 1)).contains("ollama"), F.regexp_extract(name, custom, 2))
    local = F.lower(who).contains("ollama") | url.contains("ollama") | url.contains(":11434") | space.isNotNull() | name.rlike(r"^.*\S.*:[^:]*[^:\s][^:]*$")
    pair = lambda p, m: F.struct(p.alias("provider"), m.alias("model"))
    return (
        F.when(name.rlike(cloud), pair(F.regexp_extract(name, cloud, 1), F.trim(F.regexp_extract(name, cloud, 2))))
        .when(local, pair(F.lit("ollama"), F.coalesce(space, name))).otherwise(pair(F.coalesce(F.nullif(who, F.lit("")), F.lit(fallback)), name))
    )


def is_placeholder(model_: Column) -> Column:
    return model_.like("<%>")
