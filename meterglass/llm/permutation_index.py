"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. Each shard of the rows posts its vectors in one inverted file
a pivot, with the pivot's place in the vector's order. A query adds up, over the files of its own nearest pivots, how
little the places differ (the footrule distance, turned round); the best share of a shard by that is ranked again by
the exact cosine. Shards and groups of queries meet in blocks, and each query keeps its best over all shards. Each
vector is in NEAREST of the PIVOTS files, and a query opens as many: it meets NEAREST ** 2 / PIVOTS postings a vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Pivots: the distinct vectors of least hash. How many of them represent a vector.
PIVOTS, NEAREST = 1_024, 96
#: Rows of a shard and queries of a group, about; one row in so many of a shard is ranked again.
SHARD, QUERIES, SHARE = 32_768, 32_768, 12


def usable(vector: str) -> Column:
    """Vectors that have a direction: no nulls, finite, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is about one and squares stay finite; exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def matrix(vectors: pd.Series) -> np.ndarray:
    return scaled(np.stack(vectors.to_numpy()).astype(np.float64))


def places(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    close = x @ pivots.T
    nearest = min(nearest, len(pivots))
    top = np.argpartition(-close, nearest - 1, axis=1)[:, :nearest]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, axis=1), axis=1, kind="stable"), axis=1)


def search(queries: pd.DataFrame, rows: pd.DataFrame, pivots: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of one shard's rows for each query: (query_id, vec_id, score)."""
    if queries.empty or rows.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    rows = rows.sort_values("id")
    x, q = matrix(rows["v"]), matrix(queries["v"])
    ids, query_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
    norm = np.sqrt((x * x).sum(axis=1))
    later = np.arange(len(rows))
    order = places(x, pivots, NEAREST)
    depth = order.shape[1]
    # inverted files: entries sorted by pivot, (row, place) each
    by_pivot = np.argsort(order.reshape(-1), kind="stable")
    row, place = np.divmod(by_pivot, depth)
    edge = np.searchsorted(order.reshape(-1)[by_pivot], np.arange(len(pivots) + 1))
    take = max(4 * k, -(-len(rows) // SHARE))
    out = []
    for query_id, vector, mine in zip(query_ids, q, places(q, pivots, NEAREST), strict=True):
        near = np.zeros(len(rows), np.int64)
        for at, pivot in enumerate(mine):
            a, b = edge[pivot], edge[pivot + 1]
            near[row[a:b]] += depth - np.abs(place[a:b] - at)
        # no two are equal: of equally near ones those with smaller ids come first
        best = np.argpartition(later - near * len(rows), take - 1)[:take] if take < len(rows) else later
        best = best[ids[best] != query_id]
        score = (x[best] * vector).sum(axis=1) / (norm[best] * np.sqrt((vector * vector).sum()))
        top = np.lexsort((ids[best], -score))[:k]
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[best[top]], "score": score[top]}))
    return pd.concat(out)


def neighbours(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest to each row for which `queries` is true, by cosine.

    Nearest first, ties to the smaller key; a row is no neighbour of itself. Rows take part if key and vector are
    there, the vector has a direction and its length is the most frequent one (the larger of equals). Of rows with one
    key the least vector counts. Of equal vectors, k + 1 of the least keys can be among the nearest, so only these are
    posted; all of them may be queries. All vectors that take part are indexed.
    """
    spark = vectors.sparkSession
    # one row a key: partial aggregation first, so many copies of one vector are no hot spot
    rows = vectors.where(F.col(key).isNotNull() & usable(vector)).groupBy(F.col(key)).agg(F.min(vector).alias("v"))
    rows = common.cut(rows)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (size["d"] if size else 0)).withColumn("asks", queries).select(F.col(key).alias("id"), "v", "asks")
    nth = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("id"))
    posted = common.cut(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("id", "v"))
    sample = posted.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(PIVOTS).collect()  # of bounded size
    pivots = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), size["d"] if size else 1)
    pivots = scaled(pivots) if len(pivots) else pivots
    pivots /= np.sqrt((pivots * pivots).sum(axis=1, keepdims=True))
    sent = spark.sparkContext.broadcast(pivots)
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, groups = max(1, -(-counts["n"] // SHARD)), max(1, -(-counts["q"] // QUERIES))
    index = posted.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    asked = rows.where("asks").select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("g"))
    kind = dict(rows.dtypes)["id"]
    found = asked.groupBy("shard", "g").cogroup(index.groupBy("shard", "g")).applyInPandas(lambda a, b: search(a, b, sent.value, k), f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
