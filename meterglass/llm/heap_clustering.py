"""k-means in integers by heap-ordered bounds, with the result of plain rounds.

Vectors lie in blocks. In a block each cluster has a heap of its vectors by their gap: how much nearer the own centroid
is than the second nearest. When centroids move, a gap shrinks at most by the way of the own one and the longest way of
another; this drift is added up per cluster and compared with all of a heap at its top, so a heap's other entries aren't
touched. Vectors whose gap has expired are popped, compared with all centroids, and pushed to the heap that they belong
to. What joins and leaves a cluster changes its sums; only these changes leave the blocks.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors of a block, at most.
BLOCK = 4_096
#: Components beyond this would have squared distances that a 64-bit integer can't hold.
MOST = 1 << 27
#: Up to this size, products and their sums are exact in double precision.
EXACT = 1 << 22
#: Heaps of a block, one after the other, each in heap order; how many entries each has; what joined and left clusters.
STATE = "x binary, wide boolean, entry binary, gap binary, sizes array<int>, change array<struct<c: int, n: long, s: array<long>>>"


def whole_numbers(vector: str, size: int) -> tuple[Column, Column]:
    """Whether a vector has `size` components, none null or non-finite; and floor(256 * x) of each."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == size) & ~bad, F.lit(False)), F.transform(v, lambda x: F.floor(x.cast("double") * 256))


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Block:
    """Vectors and the heaps of their gaps; each gap as it was, plus the drift of its cluster at that time."""

    def __init__(self, x: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.x, self.heaps = x, heaps

    @classmethod
    def read(cls, x: bytes, wide: bool, entry: bytes, gap: bytes, sizes: list[int], dims: int) -> Block:
        rows, gaps, ends = np.frombuffer(entry, np.int32).tolist(), np.frombuffer(gap, np.float64).tolist(), np.cumsum([0, *sizes])
        heaps = [list(zip(gaps[a:b], rows[a:b], strict=True)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return cls(np.frombuffer(x, np.int32 if wide else np.int16).reshape(-1, dims).astype(np.int64), heaps)

    def written(self) -> tuple[bytes, bool, bytes, bytes, list[int]]:
        wide = bool(np.abs(self.x).max(initial=0) > 32_767)
        flat = [e for h in self.heaps for e in h]
        return self.x.astype(np.int32 if wide else np.int16).tobytes(), wide, np.array([r for _, r in flat], np.int32).tobytes(), np.array([g for g, _ in flat], np.float64).tobytes(), [len(h) for h in self.heaps]

    def step(self, centroids: np.ndarray, drift: np.ndarray, first: bool) -> list[dict]:
        """Pops what has expired, puts it where it belongs, and says what joined and left each cluster."""
        rows, old = [], []
        if first:
            rows, old = list(range(len(self.x))), [-1] * len(self.x)
        for c, heap in enumerate(self.heaps):
            limit = drift[c] * (1 + 1e-12)
            while heap and heap[0][0] <= limit:
                rows.append(heapq.heappop(heap)[1])
                old.append(c)
        if not rows:
            return []
        d = squares(self.x[rows], centroids)
        new = d.argmin(axis=1)  # the first of equals: the smaller number
        near = np.sqrt(np.take_along_axis(d, new[:, None], axis=1)[:, 0].astype(np.float64))
        other = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) if len(centroids) > 1 else np.full(len(rows), np.inf)
        # a little less than the gap, so that rounding never keeps a vector whose nearest centroid has changed
        gap = other - near - 1e-9 * (near + np.where(np.isinf(other), 0, other)) + drift[new]
        for r, c, g in zip(rows, new.tolist(), gap.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (g, r))
        old = np.array(old)
        moved = np.flatnonzero(old != new)
        out = []
        for c in np.union1d(new[moved], old[moved]):
            if c >= 0:
                came, went = (self.x[[rows[i] for i in moved[at[moved] == c]]] for at in (new, old))
                out.append({"c": int(c), "n": len(came) - len(went), "s": (came.sum(axis=0) - went.sum(axis=0)).tolist()})
        return out

    def clusters(self) -> np.ndarray:
        out = np.zeros(len(self.x), np.int32)
        for c, heap in enumerate(self.heaps):
            out[[r for _, r in heap]] = c
        return out


def starts(kept: DataFrame, key: str, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and key, in that order; a null key starts nothing."""
    order = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)
    rows = kept.where(F.col(key).isNotNull()).select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in rows], np.int64)


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, key: str = "vec_id", vector: str = "embedding", seed: str = "2:") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Vectors take part that have `size` components, none null or non-finite; each component x counts as floor(256 * x).
    The result is that of plain rounds: each assigns all vectors to the nearest centroid (ties: the smaller number) and
    replaces the centroids that have vectors by the floor of their mean; then vectors are assigned once more. Rows that
    share a key each count. Rows without a key take part but start no cluster; if there is no key at all, nothing is
    returned. With fewer than k rows there are as many clusters as rows. Integers beyond MOST in size raise ValueError.
    Other columns aren't returned.
    """
    spark, folder = vectors.sparkSession, f"{common.shared_folder(vectors.sparkSession)}/clusters-{uuid.uuid4().hex}"
    fit, numbers = whole_numbers(vector, size)
    kept = vectors.where(fit).select(F.col(key).alias("id"), numbers.alias("x"))
    kind = dict(kept.dtypes)["id"]
    centroids = starts(kept, "id", k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    drift, sums, counts = np.zeros(k), np.zeros((k, size), np.int64), np.zeros(k, np.int64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Block]]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, size)
            if np.abs(x).max(initial=0) > MOST or x.min(initial=0) < -MOST:
                raise ValueError(f"components beyond {MOST} / 256 have distances that no 64-bit integer holds")
            for a in range(0, len(x), BLOCK):
                yield batch.column(0)[a : a + BLOCK], Block(x[a : a + BLOCK], [[] for _ in range(k)])

    def kept_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Block]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].values, Block.read(*(batch.column(j)[i].as_py() for j in range(1, 6)), size)

    def stepper(read, centroids: np.ndarray, drift: np.ndarray, first: bool, last: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, block in read(batches):
                change = block.step(centroids, drift, first)
                if last:
                    c = block.clusters()
                    yield pa.RecordBatch.from_arrays([ids, pa.array(c), pa.array(((block.x - centroids[c]) ** 2).sum(axis=1))], ["id", "cluster", "distance"])
                else:
                    one = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([v]) for v in block.written()[:4])]
                    sizes = pa.array([block.written()[4]], pa.list_(pa.int32()))
                    told = pa.array([change], pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])))
                    yield pa.RecordBatch.from_arrays([*one, sizes, told], ["ids", "x", "wide", "entry", "gap", "sizes", "change"])

        return step

    state, read = kept, blocks
    for n in range(rounds):
        state.mapInArrow(stepper(read, centroids, drift, n == 0, False), f"ids array<{kind}>, {STATE}").write.option("compression", "zstd").parquet(f"{folder}/{n}")
        table = spark.read.parquet(f"{folder}/{n}")
        change = table.select(F.explode("change").alias("m")).select("m.c", F.posexplode(F.concat(F.array("m.n"), "m.s")).alias("i", "v"))
        for r in change.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # k * (size + 1) rows
            if r["i"]:
                sums[r["c"], r["i"] - 1] += r["v"]
            else:
                counts[r["c"]] += r["v"]
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        way = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(np.float64))
        others = np.array([np.delete(way, c).max(initial=0) for c in range(k)])
        drift, centroids = drift + (way + others) * (1 + 1e-12), moved
        state, read = table.select("ids", "x", "wide", "entry", "gap", "sizes"), kept_blocks
    rows = state.mapInArrow(stepper(read, centroids, drift, rounds == 0, True), f"id {kind}, cluster int, distance long")
    rows.write.parquet(f"{folder}/assigned")
    rows = spark.read.parquet(f"{folder}/assigned")
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digest = F.sha2(F.element_at(F.lit([",".join(map(str, c)) for c in centroids.tolist()]), F.col("cluster") + 1).cast("binary"), 256)
    of = F.element_at(F.lit([inertia.get(c, 0) for c in range(k)]), F.col("cluster") + 1).cast("long")
    return rows.select(F.col("id").alias(key), "cluster", "distance", of.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
