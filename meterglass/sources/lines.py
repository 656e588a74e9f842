"""Text files line by line, with the number that each line has in its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, *paths: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, line, value): lines count from 1 and blank ones count too.

    Rows of a file's block come in file order, so they are numbered block by block, each on its own, and moved on by the
    lines of the blocks before: a large file is not one task.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(list(paths))
    rows = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks
    counts = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("nth"))
    return rows.withColumn("within", within).join(counts, ["path", "block"]).select("path", (F.col("before") + F.col("within")).alias("line"), "value")


def documents(spark: SparkSession, *paths: str, pattern: str = "*.json", most: int | None = None) -> DataFrame:
    """(path, value) of whole files; with `most`, of the first so many in order of path."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(list(paths), wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "value")
    return rows if most is None else rows.orderBy("path").limit(most)


def parsed(rows: DataFrame) -> DataFrame:
    """Adds v, the line as VARIANT: null where it isn't JSON."""
    return rows.withColumn("v", F.try_parse_json("value"))
