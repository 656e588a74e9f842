"""What filters of a corpus remove, in every order of application, kept up by a stream.

All files are read in micro-batches. What a text fails by itself is a mask of bits; whether an earlier document has the
same text is known once all ids are, so keyed state holds the least id of each text. When a smaller one arrives, the
mask that was counted for the earlier one is retracted and counted anew with the bit of copies. Each round writes signed
counts per part and mask; their sum is what one pass over everything would count, in any order of files.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import common

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of files in a micro-batch, at least, and micro-batches, at most: state is committed once for each.
LEAST_BYTES, MOST_ROUNDS = 128 << 20, 64
#: Texts whose state is kept together, about: a round reads and writes it whole, which costs less than many small states.
TEXTS = 4_096
#: Groups that a task adds up before it hands them on.
GROUPS = 1 << 16
ARRIVAL = "h binary, part string, mask int, good boolean, toxic boolean, low long, n long, n_low long"
SIGNED = "part string, mask int, good boolean, toxic boolean, n long"


_CAPITALS, _SIGNS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails. Bytes split at exactly the six white spaces that part words."""
    words = text.split()
    capitals, points = len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _INNER))
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * points, len(text.translate(None, _SIGNS)) < len(text))
    return sum(1 << bit for bit, fail in enumerate(fails) if fail)


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, part) with the text's hash and mask in its place. Without an id, the hash is one of the part."""
    for batch in batches:
        ids, hashes, found = batch.column(0).to_pylist(), [], []
        for i, text, part in zip(ids, batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            found.append(own_mask(raw))
            # rows without an id are no copies of any and have none: they need no state, and their groups go by part
            hashes.append(hashlib.sha256(raw).digest() if i is not None else hashlib.sha256(part.as_buffer()).digest()[:8])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), batch.column(2), pa.array(found, pa.int32())], ["id", "h", "part", "mask"])


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, part, mask, good, toxic) to one for each group of a task, so that many copies of a text are few rows."""
    held: dict[tuple, list[int]] = {}

    def told() -> pa.RecordBatch:
        columns = list(zip(*((*k, *v) for k, v in held.items()), strict=True))
        types = (pa.binary(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["h", "part", "mask", "good", "toxic", "low", "n", "n_low"])

    for batch in batches:
        for i, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = held.setdefault(tuple(key), [-1 if i is None else i, 0, 0])
            at[1] += 1
            if i is not None:
                if i < at[0]:
                    at[0], at[2] = i, 0
                at[2] += i == at[0]
        if len(held) >= GROUPS:
            yield told()
            held = {}
    if held:
        yield told()


def retracted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Signed counts of the arrivals of some texts. State: each text's least id, and how many rows of what kind have it."""
    texts: dict[bytes, tuple[int, dict[tuple, int]]] = pickle.loads(state.get[0]) if state.exists else {}
    out: dict[tuple, int] = {}

    def count(kind: tuple, mask: int, n: int) -> None:
        k = (kind[0], mask, *kind[1:])
        out[k] = out.get(k, 0) + n

    for rows in batches:
        for h, part, mask, good, toxic, i, n, n_low in zip(*(rows[c].tolist() for c in ("h", "part", "mask", "good", "toxic", "low", "n", "n_low")), strict=True):
            if len(h) < 32:  # without an id
                count((part, good, toxic), mask, n)
                continue
            low, first = texts.get(h, (None, {}))
            count((part, good, toxic), mask | COPY, n)
            if low is not None and i > low:
                continue
            if low is None or i < low:
                for kind, k in first.items():  # these have been counted as first, and are copies now
                    count(kind, mask, -k)
                    count(kind, mask | COPY, k)
                first = {}
                texts[h] = (i, first)
            count((part, good, toxic), mask | COPY, -n_low)
            count((part, good, toxic), mask, n_low)
            first[part, good, toxic] = first.get((part, good, toxic), 0) + n_low
    state.update((pickle.dumps(texts, pickle.HIGHEST_PROTOCOL),))
    yield pd.DataFrame([(*k, n) for k, n in out.items() if n], columns=["part", "mask", "good", "toxic", "n"])


def judged(labels: DataFrame, key: str) -> DataFrame:
    """(l_id, good, toxic): one row for each labelled id; of repeated ones the largest value of each label counts."""
    yes = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)) == 1
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("l_id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))


def masks(docs: DataFrame, labels: DataFrame, folder: str, buckets: int = 64, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail exactly the filters of the mask.

    docs: a stream of documents, which is read until what is there now has come; folder: where rounds, state and progress
    go. State is kept by the provider that the session names (spark.sql.streaming.stateStore.providerClass): about 70
    bytes a text, in memory by default, on the executors' disks with RocksDB. buckets: texts are dealt to as many by their hash, each with its part of the state. A run that was stopped goes on from there, and a round that is offered twice replaces itself.
    """
    spark = docs.sparkSession
    known = common.cut(judged(labels, key))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.mapInArrow(marked, "id long, h binary, part string, mask int")
    # rows without an id have no label, and are dealt out by their part and not all to one task
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("h")).otherwise(0))
    rows = rows.join(known.withColumn("l_salt", F.lit(0).cast("long")), (F.col("id") == F.col("l_id")) & (F.col("salt") == F.col("l_salt")), "left")
    rows = rows.select("id", "h", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    groups = rows.mapInArrow(added_up, ARRIVAL)

    def publish(batch: DataFrame, n: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{folder}/counts/round={n}")

    groups = groups.withColumn("of", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    stream = groups.groupBy("of").applyInPandasWithState(retracted, SIGNED, "texts binary", "update", GroupStateTimeout.NoTimeout)
    spark.createDataFrame([], SIGNED).write.mode("overwrite").parquet(f"{folder}/counts/round=-1")  # there is a table, whatever comes
    query = stream.writeStream.foreachBatch(publish).outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(SIGNED).parquet(f"{folder}/counts").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders() -> Column:
    """One row for each order of the filters and step: bits of the filters before it, bit of its own."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order):
            rows.append({"o": "".join(order), "s": step + 1, "p": before, "f": 1 << FILTERS.index(name)})
            before |= rows[-1]["f"]
    return F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<o: string, s: int, p: int, f: int>>"))


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from masks.

    kept[S], the documents that pass all filters of a set S, gives everything else by differences; one aggregation of
    32 sets for each part and kind of document, then 600 rows a part.
    """
    sets = range(1 << len(FILTERS))
    kept = lambda c: F.array(*(F.coalesce(F.sum(F.when(c & (F.col("mask").bitwiseAND(s) == 0), F.col("n"))), F.lit(0)).cast("long") for s in sets))
    parts = counts.groupBy("part").agg(kept(F.lit(True)).alias("k"), kept(F.col("good")).alias("g"), kept(F.col("toxic")).alias("t"))
    ways = {0: 24, 1: 6, 2: 4, 3: 6, 4: 24}  # orders in which a given set of so many comes before a given filter
    alone = []
    for bit in range(len(FILTERS)):
        terms = [(F.col("k")[s] - F.col("k")[s | 1 << bit]) * ways[s.bit_count()] for s in sets if not s >> bit & 1]
        alone.append(sum(terms[1:], terms[0]))
    parts = parts.withColumn("shapley", F.array(*alone))
    rows = parts.select("*", orders())
    at = lambda c, s: F.col(c)[s]
    after, own, every = F.col("p").bitwiseOR(F.col("f")), F.col("f"), F.lit((1 << len(FILTERS)) - 1)
    removed = at("k", F.col("p")) - at("k", after)
    lost = lambda c: at(c, F.col("p")) - at(c, after)
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), at("k", after).alias("kept"), removed.alias("removed"), (F.col("k")[0] - at("k", own) - removed).alias("redundant"),
        (at("k", every - own) - at("k", every)).alias("unique_fails"), lost("g").alias("good_lost"), lost("t").alias("toxic_lost"), at("shapley", F.log2("f").cast("int")).alias("shapley"),
    )


def documents(spark: SparkSession, path: str, *columns: str, least_bytes: int = LEAST_BYTES, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """A stream of a Parquet file or a folder of them, in micro-batches that grow with it: at most about `most_rounds`."""
    still = spark.read.parquet(path)
    files = still.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    total = files.distinct().agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    schema = T.StructType([still.schema[c] for c in columns] if columns else still.schema.fields)
    path = path.rstrip("/")  # as a pattern, since a stream takes a single file by pattern only
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", max(least_bytes, -(-total // most_rounds))).parquet(f"{path[:-1]}[{path[-1]}]")


def interactions(spark: SparkSession, path: str, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", **rounds: int) -> DataFrame:
    """The audit of the documents in a folder of Parquet files; see `audit` for the columns.

    Filters, by what fails: A under 200 words, B less than half of the words distinct, C over 2 % capitals A-Z, D one of
    #$%&*|, E the text of a smaller id. Null texts are empty, null parts the empty string; rows without an id are no
    copies and have none, and no labels. Rows that share an id and a text are no copies of each other. The key is an
    integer. Without documents there are no rows.
    """
    folder = f"{common.shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    buckets = max(1, -(-spark.read.parquet(path).count() // TEXTS))
    return audit(masks(documents(spark, path, key, text, part, **rounds), labels, folder, buckets, key, text, part))
