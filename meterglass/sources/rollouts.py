"""Rollouts: ordered JSON lines of a file with cumulative counters, and context that later lines build on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .messages import at

COUNTERS = {"input": "input_tokens", "cache_read": "cached_input_tokens", "cache_write": "cache_write_input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens"}
#: With the sum that a file states itself.
STATED = COUNTERS | {"total": "total_tokens"}
PACKED = r"\.jsonl\.zst$"


def shadowed(files: DataFrame) -> DataFrame:
    """Adds shadowed to (path, origin): of one relative path, the live tree's file counts and the other doesn't.

    A packed file isn't read (skipped is set) but shadows and is shadowed like the plain file of its name.
    """
    rows = files.withColumn("name", F.regexp_replace("path", PACKED, ".jsonl")).withColumn("skipped", F.col("path").rlike(PACKED))
    live = rows.where("origin = 'live'").select("name", F.lit(True).alias("has_live")).distinct()
    rows = rows.join(live, "name", "left")
    return rows.withColumn("shadowed", (F.col("origin") != "live") & F.coalesce("has_live", F.lit(False))).drop("has_live", "name")


def gains() -> dict[str, Column]:
    """What a line adds to each counter, and whether one fell: from totals t_, those before it p_, and stated gains l_.

    Where no total fell and one has grown, stated gains count if they are not all zero; else differences, never below
    zero. The sum that a file states itself is compared too.
    """
    zero = F.lit(0).cast("bigint")
    fell, grew = (reduce(lambda a, b: a | b, [F.col(f"{x}_{k}") > F.col(f"{y}_{k}") for k in STATED]) for x, y in (("p", "t"), ("t", "p")))
    stated = reduce(lambda a, b: a | b, [F.col(f"l_{k}") > 0 for k in STATED])
    out = {f"tok_{k}": F.when(~fell & grew & stated, F.col(f"l_{k}")).otherwise(F.greatest(F.col(f"t_{k}") - F.col(f"p_{k}"), zero)) for k in COUNTERS}
    return out | {"regressed": fell}


def stated() -> dict[str, Column]:
    """Totals t_ and gains l_ that a line states."""
    return {f"{p}_{k}": X.lossy_count(at(f"payload.info.{name}_token_usage.{c}")) for p, name in (("t", "total"), ("l", "last")) for k, c in STATED.items()}


def context(kind: Column) -> dict[str, Column]:
    """What a line says for those after it; null for nothing."""
    said = lambda of, path: F.when(kind == of, F.nullif(F.trim(X.text_or_number(at(f"payload.{path}"))), F.lit("")))
    return {"session_id": said("session_meta", "id"), "meta_provider": said("session_meta", "model_provider"), "full_model": said("turn_context", "model"), "project_dir": said("turn_context", "cwd")}


def named(session: Column, provider: Column, full_model: Column, ordinal: Column) -> dict[str, Column]:
    """A record's names, from its line and what was said before."""
    model = X.split_namespace(full_model, "codex")
    file = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    uuid = F.regexp_extract(file, r"([0-9a-fA-F-]{36})$", 1)
    return {
        "message_id": F.concat_ws("#", "path", F.coalesce(F.when(F.trim(ordinal) != "", ordinal), F.col("line").cast("string"))), "session_id": F.coalesce(session, F.when(uuid != "", uuid).otherwise(file)),
        "provider_id": F.when(model["provider"] == "codex", F.coalesce(provider, F.lit("codex"))).otherwise(model["provider"]), "model_id": F.coalesce(model["model"], F.lit("unknown")),
    }


RECORD = ("path", "line", "message_id", "session_id", "time_created_utc", "project_dir", "provider_id", "model_id", *(f"tok_{k}" for k in COUNTERS), "regressed", "is_incomplete")


def incomplete() -> Column:
    return F.col("tok_input") + F.col("tok_output") + F.col("tok_cache_read") + F.col("tok_cache_write") == 0


def events(lines: DataFrame) -> DataFrame:
    """Token count events of (path, line, value, v) lines with what earlier lines of their file said, and skip_reason.

    A file with a malformed line is left out whole; blank lines count but say nothing.
    """
    lines = lines.where(F.trim("value") != "").join(broken(lines), "path", "left_anti")
    kind = X.text_or_number(at("type"))
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumns({c: F.last(x, ignorenulls=True).over(so_far) for c, x in context(kind).items()}).withColumn("project_dir", F.coalesce("project_dir", F.lit("")))
    rows = rows.where(counts(kind))
    return rows.withColumn("time_created_utc", created()).withColumn("skip_reason", reason(F.col("time_created_utc")))


def counts(kind: Column) -> Column:
    return (kind == "event_msg") & (X.text_or_number(at("payload.type")) == "token_count")


def created() -> Column:
    return X.instant_ms(X.text_or_number(at("timestamp")))


def reason(time: Column) -> Column:
    """Why a token count event gives no record."""
    total = at("payload.info.total_token_usage")
    out = F.when(total.isNull() | (F.schema_of_variant(total) == "VOID"), "total_missing").when(~F.schema_of_variant(total).startswith("OBJECT"), "total_invalid")
    return out.when(time.isNull(), "time_invalid")


def broken(lines: DataFrame) -> DataFrame:
    """(path) of files with a line that is no JSON object."""
    return lines.where((F.trim("value") != "") & (F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"))).select("path").distinct()


def skips(lines: DataFrame) -> DataFrame:
    """(skip_reason, n): token count events that give no record, by reason, and files left out whole."""
    files = broken(lines).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("file_malformed").alias("skip_reason"), "n")
    return events(lines).where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n")).unionByName(files)


def records(lines: DataFrame) -> DataFrame:
    """Records of (path, line, value, v) lines: one for each token count event, with what it adds to the counters.

    The previous total is that of the last valid one, whatever its time; see `gains` for what is added. A total that
    hasn't grown gives zeros, and one that fell is marked.
    """
    w = Window.partitionBy("path").orderBy("line")
    rows = events(lines)
    valid = rows.where("skip_reason is null or skip_reason = 'time_invalid'").withColumns(stated())
    valid = valid.withColumns({f"p_{k}": F.coalesce(F.lag(f"t_{k}").over(w), F.lit(0).cast("bigint")) for k in STATED})
    valid = valid.withColumns(gains() | named(F.col("session_id"), F.col("meta_provider"), F.col("full_model"), X.text_or_number(at("ordinal"))))
    return valid.where("time_created_utc is not null").withColumn("is_incomplete", incomplete()).select(*RECORD)
