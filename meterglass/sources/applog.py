"""Application logs in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("trace", "debug", "info", "warn", "error")
MOST = 2000


def entries(lines: DataFrame) -> DataFrame:
    """(timestamp, level, target, message) of lines that are JSON with a known level."""
    rows = lines.select(F.from_json("value", "timestamp string, level string, target string, message string").alias("e")).select("e.*")
    rows = rows.withColumn("level", F.lower("level"))
    return rows.where(F.col("level").isin(*LEVELS))


def at_least(rows: DataFrame, level: str) -> DataFrame:
    """Entries of this severity or above."""
    return rows.where(F.col("level").isin(*LEVELS[LEVELS.index(level) :]))


def newest(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The last entries, newest first; between 1 and MOST of them."""
    return rows.orderBy(*map(F.desc, order)).limit(min(max(limit, 1), MOST))
