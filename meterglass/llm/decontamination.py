"""Benchmark decontamination: which words of a document lie inside passages of benchmark items.

All windows of all items go into one Aho-Corasick automaton over normalised text. Each document is scanned once;
match ends are mapped back to word numbers and from there to code points of the original text. A benchmark too large for
one automaton is dealt to several; documents are then scanned once for each, one after the other, so that neither the
driver nor a task ever holds more than one.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Characters of window text in one automaton, about. A larger benchmark is dealt to several automata of this size.
MOST_PATTERN_CHARS = 6_000_000
#: The automaton that a Python worker built last, by name.
_BUILT: dict[str, "Automaton"] = {}
ADDED = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"


def joined(text: str) -> str:
    """Normalised words with one space before, between and after them, one character a byte."""
    found = common.words(text)
    return f" {b' '.join(found).decode('latin-1')} " if found else ""


def windows(normal: str, size: int) -> Iterator[str]:
    """Every run of `size` consecutive words (all words, if there are fewer)."""
    found = normal.strip(" ").split(" ")  # at the space alone: \x85 and \xa0 are bytes of letters here
    for i in range(max(1, len(found) - size + 1)):
        yield f" {' '.join(found[i : i + size])} "


class Automaton:
    def __init__(self, items: list[tuple[str | None, str]], size: int):
        of: dict[str, set[str | None]] = defaultdict(set)
        for item, normal in items:
            for w in windows(normal, size):
                of[w].add(item)
        self.machine = ahocorasick.Automaton()
        for w, ids in of.items():
            self.machine.add_word(w, (len(w), w.count(" ") - 1, frozenset(ids)))
        if of:
            self.machine.make_automaton()
        self.empty = not of

    def hits(self, normal: str) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words (first, after last) and the items with occurring windows, null ids apart."""
        if self.empty or not normal:
            return [], set()
        found = list(self.machine.iter(normal))
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(spaces, [end for end, _ in found])
        runs = sorted({(int(e) - n, int(e)) for e, (_, (_, n, _)) in zip(last, found, strict=True)})
        return merged(runs), {i for _, (_, _, ids) in found for i in ids if i is not None}


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def code_points(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Word runs as code point spans of the original text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    word = np.frombuffer(common.WORD_BYTES, np.uint8)[raw] != 32
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in runs]


def shard(items: DataFrame, n: int, k: int) -> list[tuple[str | None, str]]:
    """The k-th of n shards of items (id, t), normalised: of bounded size, as n is chosen by size."""
    rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k).toLocalIterator()
    return [(r.id, normal) for r in rows if (normal := joined(r.t))]


def built(sent: Broadcast, name: str, size: int) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(sent.value, size)
    return _BUILT[name]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, text: str = "text") -> DataFrame:
    """Adds n_words, n_hit, n_items, items (sorted strings), spans (code points of hit passages) and contaminated.

    Windows are `size` consecutive words of an item, or all its words if it has fewer. A document is contaminated if
    words are hit and they are at least one in `one_in`. Null and wordless texts have no words and are clean; null items
    are ignored; items without an id mark words but are not listed; equal items count once; columns of the names above
    are replaced, other columns are kept. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("t")).where("t is not null").distinct()
    chars = items.agg(F.sum(F.octet_length("t").cast("long")).alias("n")).first()["n"] or 0
    n = max(1, -(-chars * size // MOST_PATTERN_CHARS))
    types = to_arrow_schema(T.StructType.fromDDL(ADDED))

    def described(original: str, normal: str, runs: list[tuple[int, int]], found: Iterable[str]) -> tuple:
        words = max(0, normal.count(" ") - 1)
        return words, sum(b - a for a, b in runs), len(set(found)), sorted(set(found)), code_points(original, runs) if runs else []

    def columns(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)]

    if n == 1:
        sent, name = spark.sparkContext.broadcast(shard(items, 1, 0)), uuid.uuid4().hex

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = built(sent, name, size)
            for batch in common.slices(batches, text):
                rows = []
                for value in batch.column(batch.schema.get_field_index(text)):
                    original = value.as_py() or ""
                    normal = joined(original)
                    rows.append(described(original, normal, *machine.hits(normal)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns(rows)], [*batch.schema.names, *types.names])

        out = docs.mapInArrow(scanned, common.plus(docs, ADDED))
    else:
        keys = [F.xxhash64(text), F.xxhash64(text, F.lit(1))]  # what is found depends on the text alone
        texts = docs.select(keys[0].alias("h1"), keys[1].alias("h2"), F.col(text).alias("text"))
        parts = [hits_of(texts, shard(items, n, k), size) for k in range(n)]
        found = reduce(DataFrame.union, parts).groupBy("h1", "h2").agg(F.flatten(F.collect_set("runs")).alias("runs"), F.flatten(F.collect_set("items")).alias("items"))
        pairs = docs.select(F.struct("*").alias("d"), keys[0].alias("h1"), keys[1].alias("h2")).join(found, ["h1", "h2"], "left").select("d", "runs", "items")

        def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = pa.RecordBatch.from_struct_array(batch.column(0))
                rows = []
                for value, runs, ids in zip(whole.column(whole.schema.get_field_index(text)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    original = value.as_py() or ""
                    rows.append(described(original, joined(original), merged([(r["first"], r["last"]) for r in runs or []]), ids or []))
                if rows:
                    yield pa.RecordBatch.from_arrays([*whole.columns, *columns(rows)], [*whole.schema.names, *types.names])

        out = pairs.mapInArrow(finished, common.plus(docs, ADDED))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def hits_of(texts: DataFrame, items: list[tuple[str | None, str]], size: int) -> DataFrame:
    """(h1, h2, runs, items) of the texts (h1, h2, text) that one shard of items hits; written, so that the shard can go."""
    sent, name = texts.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    schema = "h1 long, h2 long, runs array<struct<first:int,last:int>>, items array<string>"
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = built(sent, name, size)
        for batch in common.slices(batches, "text"):
            out = []
            for row in batch.to_pylist():
                runs, ids = machine.hits(joined(row["text"] or ""))
                if runs:
                    out.append({"h1": row["h1"], "h2": row["h2"], "runs": [{"first": a, "last": b} for a, b in runs], "items": sorted(ids)})
            yield pa.RecordBatch.from_pylist(out, types)

    found = common.cut(texts.mapInArrow(scanned, schema))
    sent.destroy()
    return found


def items_digest(items: str = "items") -> Column:
    """SHA-256 of the sorted item ids, joined with commas."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
