"""Message exports: one row a message, with a JSON document of free form; and the older tree of one file a message."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..schema import ORIGINS, USAGE

REASONS = ("not_json", "not_assistant", "tokens_missing", "tokens_invalid")


def at(path: str, v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), f"$.{path}", "variant")


#: Parts of a document that are taken out of it in one go, as they are.
PARTS = ("role", "tokens", "providerID", "modelID", "model", "cost", "time", "agent", "mode", "variant", "path", "id", "sessionID")
DOCUMENT = T.StructType([*(T.StructField(p, T.VariantType()) for p in PARTS), T.StructField("_broken", T.StringType())])


def parsed(rows: DataFrame, data: str) -> DataFrame:
    """Adds j, the parts of the document; null where it is no JSON object.

    Unfolded from a list of one: filters on j would otherwise be moved below it and read the text again for each use.
    """
    j = F.from_json(F.when(F.ltrim(data).startswith("{"), F.col(data)), DOCUMENT, {"columnNameOfCorruptRecord": "_broken"})
    return rows.select("*", F.explode(F.array(j)).alias("j")).withColumn("j", F.when(F.col("j._broken").isNull(), F.col("j")))


def skip_reason() -> Column:
    """Why a document is no usage record: the first test that it fails; null for a record."""
    return (
        F.when(F.col("j").isNull(), "not_json")
        .when(~F.coalesce(F.try_variant_get("j.role", "$", "string") == "assistant", F.lit(False)), "not_assistant")
        .when(F.col("j.tokens").isNull(), "tokens_missing")
        .when(~F.schema_of_variant("j.tokens").startswith("OBJECT"), "tokens_invalid")
    )


def normalised(rows: DataFrame, data: str = "data", keep: bool = False) -> DataFrame:
    """Adds the record's fields and skip_reason to rows with a JSON document each. Wrong types count as absent.

    keep: leaves j, the document's parts, in the result.
    """
    rows = parsed(rows, data).withColumn("skip_reason", skip_reason())
    text = lambda part, path="": F.try_variant_get(F.col(f"j.{part}"), f"${path}", "string")
    name = lambda part, path="": X.text_or_number(F.try_variant_get(F.col(f"j.{part}"), f"${path}", "variant") if path else F.col(f"j.{part}"))
    counters = {"tok_input": ".input", "tok_output": ".output", "tok_reasoning": ".reasoning", "tok_cache_read": ".cache.read", "tok_cache_write": ".cache.write"}
    times = {"time_created_utc": ".created", "time_completed_utc": ".completed", "time_updated": ".updated"}
    agent = X.text_only(F.col("j.agent"))
    # step by step, as each is looked at several times: text, numbers, and what counts of them
    rows = rows.withColumns({f"_{c}": F.trim(text("tokens", path)) for c, path in counters.items()} | {f"_{c}": F.trim(text("time", path)) for c, path in times.items()} | {"_cost": text("cost")})
    rows = rows.withColumns({f"_w_{c}": F.col(f"_{c}").try_cast("bigint") for c in (*counters, *times)} | {"_cost": X.number(F.col("_cost"))})
    rows = rows.withColumns({f"_w_{c}": F.coalesce(f"_w_{c}", X.cut_off(F.col(f"_{c}").try_cast("double"))) for c in (*counters, *times)})
    either = lambda field: F.coalesce(name(field), name("model", f".{field}"))
    zero = F.lit(0).cast("bigint")
    fields = {c: F.greatest(F.coalesce(f"_w_{c}", zero), zero) for c in counters} | {c: F.col(f"_w_{c}") for c in times} | {f: F.coalesce(either(c), F.lit("unknown")) for f, c in (("provider_id", "providerID"), ("model_id", "modelID"))}
    rows = rows.withColumns(fields | {"cost": F.when(F.col("_cost") > 0, F.col("_cost")), "agent_raw": F.when(F.trim(agent) != "", agent).otherwise("unknown"), "variant": F.coalesce(name("variant"), name("model", ".variant")), "project_dir": F.coalesce(name("path", ".cwd"), F.lit(""))})
    rows = rows.withColumns({
        "agent_key": X.agent_key(F.col("agent_raw")), "cost_source": F.when(F.col("cost").isNotNull(), "actual").otherwise("unavailable"),
        "is_incomplete": (X.all_tokens() == 0) & F.col("time_completed_utc").isNull(),
    }).drop("_cost", *(f"{p}{c}" for c in (*counters, *times) for p in ("_", "_w_")))
    return rows if keep else rows.drop("j")


def records(rows: DataFrame, host_id: str, origin: str = "live", source: str = "opencode") -> DataFrame:
    """The usage records of a message export: id, session_id, time_created, time_updated and data."""
    # the export's own update time, which the document's must not replace
    rows = normalised(rows.withColumnRenamed("time_updated", "_updated")).where("skip_reason is null")
    given = {"host_id": host_id, "source": source, "granularity": "message", "origin": origin, "origin_priority": ORIGINS[origin]}
    rows = rows.withColumns({c: F.lit(v) for c, v in given.items()} | {"message_id": F.col("id"), "time_created_utc": F.col("time_created"), "source_time_updated": F.col("_updated")})
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in USAGE))


def backups(spark: SparkSession, paths: list[str], host_id: str, enabled: bool) -> DataFrame:
    """The records of backup copies of an export: all of them, without a watermark. Not enabled: nothing is read.

    A backup's records never displace live ones, and move no cursor: their origin tells.
    """
    if not enabled or not paths:
        return spark.createDataFrame([], USAGE)
    return records(spark.read.parquet(*paths), host_id, "bak")


def legacy(files: DataFrame) -> DataFrame:
    """Records of one file each (path, value): ids fall back to file and folder names, the time of creation is a must.

    The update time is the stated one, else that of completion, else of creation; older files have no variant.
    """
    rows = normalised(files, "value", keep=True)
    file, folder = F.regexp_extract("path", r"([^/]+)\.json$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rows = rows.withColumns({"message_id": F.coalesce(X.text_or_number(F.col("j.id")), file), "session_id": F.coalesce(X.text_or_number(F.col("j.sessionID")), folder), "variant": F.lit(None).cast("string")})
    reason = F.coalesce("skip_reason", F.when(F.col("time_created_utc").isNull(), "time_missing"))
    return rows.withColumns({"skip_reason": reason, "source_time_updated": F.coalesce("time_updated", "time_completed_utc", "time_created_utc")}).drop("j", "time_updated")


def in_depth(files: DataFrame, root: str) -> DataFrame:
    """Files (path, value) that lie in a folder of their session right below root, and no deeper or higher."""
    below = F.regexp_extract("path", r"^(?:file:)?/*" + re.escape(root.strip("/")) + r"/+(.*)$", 1)
    return files.where(below.rlike(r"^[^/]+/[^/]+$"))


def skips(rows: DataFrame) -> DataFrame:
    """(skip_reason, n); their sum is the number of skipped rows."""
    return rows.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))
