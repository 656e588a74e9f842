"""The usage fact and the small tables around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
USAGE = T.StructType([
    T.StructField(*(lambda name, kind: (name, _TYPES[kind]))(*column.split()))
    for column in (
        "host_id string", "source string", "granularity string", "message_id string", "session_id string", "time_created_utc bigint", "time_completed_utc bigint",
        "source_time_updated bigint", "origin string", "origin_priority int", "agent_raw string", "agent_key string", "provider_id string", "model_id string", "variant string",
        "tok_input bigint", "tok_output bigint", "tok_reasoning bigint", "tok_cache_read bigint", "tok_cache_write bigint", "cost double", "cost_source string", "is_incomplete boolean", "project_dir string",
    )
])
KEY = ("host_id", "source", "message_id")
TOKENS = ("tok_input", "tok_output", "tok_reasoning", "tok_cache_read", "tok_cache_write")
BILLABLE = ("tok_input", "tok_output", "tok_cache_read", "tok_cache_write")
#: Where a record comes from, the more trusted the higher.
ORIGINS = {"live": 3, "bak": 2, "legacy": 1}
PRICES = ("input_per_mtok", "output_per_mtok", "cache_read_per_mtok", "cache_write_per_mtok")


class SchemaMismatch(ValueError):
    """A stored table's columns aren't those of the fact."""


def checked(df: DataFrame) -> DataFrame:
    """df, if it has the fact's columns and types in order."""
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in USAGE]
    if have != want:
        raise SchemaMismatch(f"expected {USAGE.simpleString()}, got {df.schema.simpleString()}")
    return df
