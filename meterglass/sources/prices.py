"""Price documents: read, checked, and written as a new snapshot."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pricing import InvalidPrices, checked_catalog
from ..schema import PRICES

#: Entries of a price document, at most.
MOST_ENTRIES = 100_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """(catalog_ord, provider_id, model_id, prices, raw) of a document; raw keeps the fields that aren't known."""
    body = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    if body.where("v is null or not schema_of_variant(v) like 'OBJECT%'").count():
        raise InvalidPrices(f"{path} is not a JSON object")
    if body.where("try_variant_get(v, '$.schema_version', 'int') = 1").count() != 1:
        raise InvalidPrices("only schema version 1 is known")
    rows = body.select(F.posexplode(F.expr("cast(variant_get(v, '$.entries') as array<variant>)")).alias("catalog_ord", "e"))
    get = lambda name, kind: F.try_variant_get("e", f"$.{name}", kind).alias(name)
    return checked_catalog(rows.select("catalog_ord", get("provider_id", "string"), get("model_id", "string"), *(get(p, "double") for p in PRICES), F.to_json("e").alias("raw")))


def write(catalog: DataFrame, folder: str, version: int) -> str:
    """Writes a checked catalog beside the versions before it; the reader takes the path that is returned."""
    path = f"{folder}/version={version}"
    order = F.row_number().over(Window.orderBy("catalog_ord")) - 1  # as many rows as prices
    checked_catalog(catalog).withColumn("catalog_ord", order).write.mode("errorifexists").parquet(path)
    return path


def header(spark: SparkSession, path: str) -> dict:
    """What a document says beside its entries, known or not."""
    body = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return {k: v for k, v in body.items() if k != "entries"}


def write_document(catalog: DataFrame, head: dict, folder: str, version: int) -> str:
    """Writes a checked catalog (with raw) as a document that keeps header and unknown fields; the reader takes the path.

    A price document is one small file: more than MOST_ENTRIES entries are refused.
    """
    rows = checked_catalog(catalog).orderBy("catalog_ord").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise InvalidPrices(f"more than {MOST_ENTRIES} entries")
    known = ("provider_id", "model_id", *PRICES)
    entries = [json.loads(r["raw"] or "{}") | {k: r[k] for k in known} for r in rows]
    path = f"{folder}/version={version}"
    catalog.sparkSession.createDataFrame([(json.dumps(head | {"schema_version": 1, "entries": entries}, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return path
