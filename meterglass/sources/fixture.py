"""Made-up message exports of any size with known answers: to try an ingest out, not to be analysed."""

from __future__ import annotations

from collections import defaultdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Messages that share one update time, more than a batch of a thousand; when the first message was written; its distance
#: to the next one; and the time of the shared update.
SAME, START, STEP = 1_001, 1_710_000_000_000, 7_200_000
SHARED = START + 1_000 * STEP


def messages(spark: SparkSession, n: int) -> DataFrame:
    """(id, session_id, time_created, time_updated, data): n plain messages, SAME of one update time, and two to skip.

    Every tenth plain message is incomplete, every seventh names its model in an object of its own.
    """
    i = F.col("id")
    plain = F.when(i < n, i)
    model = F.when(i % 7 == 0, '"model":{"providerID":"p","modelID":"m"}').otherwise('"providerID":"p","modelID":"m"')
    tokens = F.when(plain.isNotNull() & (i % 10 == 0), F.lit("{}")).otherwise(F.concat(F.lit('{"input":'), (i % 50 + 1).cast("string"), F.lit("}")))
    data = F.concat(F.lit('{"role":"assistant",'), model, F.lit(',"tokens":'), tokens, F.lit("}"))
    data = F.when(i == n + SAME, F.lit('{"role":"user"}')).when(i == n + SAME + 1, F.lit('{"role":"assistant"}')).otherwise(data)
    created = F.lit(START) + F.when(i < n, i * STEP).otherwise(0)
    updated = F.when((i >= n) & (i < n + SAME), F.lit(SHARED)).otherwise(created + 1)
    return spark.range(n + SAME + 2).select(F.format_string("msg-%08d", "id").alias("id"), F.format_string("ses-%d", (F.col("id") % 9)).alias("session_id"), created.alias("time_created"), updated.alias("time_updated"), data.alias("data"))


def expected(n: int) -> dict:
    """What an ingest of `messages` must find, by arithmetic: counts, and sums of each UTC day."""
    daily: dict = defaultdict(lambda: {"tok_input": 0, "records": 0, "incomplete": 0})
    for i in range(n + SAME):
        day = daily[datetime.fromtimestamp((START + (i * STEP if i < n else 0)) / 1000, UTC).date().isoformat()]
        if i < n and i % 10 == 0:
            day["incomplete"] += 1
        else:
            day["records"] += 1
            day["tok_input"] += i % 50 + 1
    return {"eligible": n + SAME, "skipped": 2, "same_time": SAME, "daily": dict(daily)}
