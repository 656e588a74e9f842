"""Near-duplicate documents by DartMinHash signatures of word shingles.

Each element of a weighted set owns a strip as wide as its weight; hashed darts fall on the strips with rate one per
unit of area, ordered by rank. Darts up to a rank that yields about k ln k + 2k of them are looked at, each goes to one
of k coordinates, and the earliest of a coordinate is its value: two sets agree there with the probability of their
weighted Jaccard similarity. Bands of coordinates that agree propose pairs, which the shingle sets then decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import common

#: Bands of coordinates; at similarity 0.8 all bands differ for one pair in 20,000.
BANDS, BAND_ROWS = 25, 5
SHINGLE = 5
#: Members of a bucket, about, on either side of a block.
BLOCK = 256
#: Slots that shingles are counted in to put the rare ones first; columns of shingles that are multiplied at once.
SLOTS, COLUMNS = 1 << 17, 1 << 12
_RANDOM = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP, _STEPS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1, modulo 2 ** 64; kept for the next call."""
    known = _POWERS.get(base)
    if known is None or known.size < n:
        known = np.full(max(n, 1 << 20), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if known.size <= 1 << 21:
            _POWERS[base] = known
    return known[:n]


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of each run of values, by where it lies in the prefix sums."""
    back = pow(base, -1, 1 << 64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(base, values.size), dtype=np.uint64)])
    return (total[ends] - total[starts]) * _powers(back, values.size + 1)[starts]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each normalised word of all texts, and the n + 1 offsets of the texts among them."""
    low = np.frombuffer(common.WORD_BYTES, np.uint8)[data]
    word = low != 32
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    inner = offsets[(offsets > 0) & (offsets < data.size)]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    h = common.mix(_runs(_RANDOM[low], starts, ends, 0x5851F42D4C957F2D) + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words inside a text (of all words, if there are fewer), and the text of each."""
    count = np.diff(offsets)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(count.size), n)
    start = offsets[:-1][row] + np.arange(row.size) - (np.cumsum(n) - n)[row]
    length = np.minimum(count[row], size)
    out = length.astype(np.uint64)
    for k in range(size):
        there = length > k
        out = np.where(there, common.mix(out * _STEP + h[np.minimum(start + k, max(0, h.size - 1))]), out) if h.size else out
    return out, row


def signatures(element: np.ndarray, row: np.ndarray, rows: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Rank of the earliest dart of each coordinate, as (rows, k) floats; infinity throughout where a row has no weight.

    Equal elements of a row count once; of their weights the largest holds.
    """
    limit = np.ones(element.size)
    if weight is not None:  # one strip of unit width for each started unit of weight
        kept = weight > 0
        element, row, weight = element[kept], row[kept], weight[kept]
        cells = np.ceil(weight).astype(np.int64)
        cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        limit = np.minimum(1.0, np.repeat(weight, cells) - cell)
        element, row = common.mix(np.repeat(element, cells) + cell.astype(np.uint64) * _STEPS), np.repeat(row, cells)
    out = np.full((rows, k), np.inf)
    total = np.bincount(row, limit, minlength=rows)
    reach = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-9), 0)
    todo = total > 0
    while todo.any():
        of = np.flatnonzero(todo[row])
        e, r, lim, rank, dart = element[of], row[of], limit[of], np.zeros(of.size), 0
        out[todo] = np.inf
        while e.size:
            dart += 1
            u = common.mix(e + np.uint64(dart * int(_STEP) & (1 << 64) - 1))
            rank = rank - np.log(((u >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53)
            near = rank <= reach[r]
            e, r, lim, rank, u = e[near], r[near], lim[near], rank[near], u[near]
            at = common.mix(u ^ _STEPS)
            hit = slice(None) if weight is None else (at & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24 < lim
            coordinate = (((at >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(out.reshape(-1), (r * k + coordinate)[hit], rank[hit])
        todo &= np.isinf(out).any(axis=1)
        reach = reach * 2
    return out


def bands(signature: np.ndarray, n: int = BANDS, size: int = BAND_ROWS) -> np.ndarray:
    """One hash for each band of `size` coordinates."""
    value = signature.view(np.uint64).reshape(len(signature), n, size)
    h = np.broadcast_to(np.arange(n, dtype=np.uint64), value.shape[:2])
    for k in range(size):
        h = common.mix(h * _STEPS + value[:, :, k])
    return h.view(np.int64)


def counted(element: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each row, their rows, and how often each is there."""
    order = np.lexsort((element, row))
    element, row = element[order], row[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, row.size), bool), (element[1:] != element[:-1]) | (row[1:] != row[:-1])]))
    return element[new], row[new], np.diff(np.append(new, row.size))


def text_keys(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """128 bits that stand for the words of each text."""
    n = np.diff(at).astype(np.uint64)
    return [common.mix(_runs(h, at[:-1], at[1:], b) + n).view(np.int64) for b in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]


def summaries(docs: DataFrame, key: str, text: str, weighted: bool = False) -> DataFrame:
    """(id, k1, k2, bands) of each document with text and id: 128 bits that stand for its words, and its bands."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            data, offsets = common.utf8(batch.column(1))
            h, at = word_hashes(data, offsets)
            n = np.diff(at)
            keys = text_keys(h, at)
            for i in np.flatnonzero(n == 0):  # no words: equal only to the very same text
                raw = hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes()).digest()
                keys[0][i], keys[1][i] = np.frombuffer(raw, np.int64)
            element, row = shingles(h, at)
            weight = None
            if weighted:
                element, row, weight = counted(element, row)
            found = bands(signatures(element, row, len(batch), BANDS * BAND_ROWS, weight))
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[n > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, keys), lists], ["id", "k1", "k2", "bands"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text <> ''")
    return rows.mapInArrow(made, "id long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """(id, k1, k2, s): the bits of a text's words, and its sorted distinct shingles as 32-bit integers.

    Two texts of n shingles each share a false one with a chance of about n * n / 2 ** 32. With weights, the second and
    further occurrences of a shingle are elements of their own, so that the Jaccard similarity is that of the counts.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            h, at = word_hashes(*common.utf8(batch.column(1)))
            keys = text_keys(h, at)
            element, row = shingles(h, at)
            if weighted:
                element, row, n = counted(element, row)
                again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                element, row = common.mix(np.repeat(element, n) + again.astype(np.uint64) * _STEPS), np.repeat(row, n)
            cuts = np.searchsorted(row, np.arange(len(batch) + 1))
            sets = [np.unique((element[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, keys), pa.array(sets, pa.binary())], ["id", "k1", "k2", "s"])

    return docs.mapInArrow(made, "id long, k1 long, k2 long, s binary")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have a Jaccard similarity of at least `least`."""

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                small, large = (x, y) if x.size <= y.size else (y, x)
                if not small.size or small.size < least * large.size - 1e-9:
                    yes.append(False)
                    continue
                both = int((large[np.minimum(np.searchsorted(large, small), large.size - 1)] == small).sum())
                yes.append(both >= least * (x.size + y.size - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(yes, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(decided, "a long, b long")


def crowded(buckets: DataFrame) -> DataFrame:
    """Members (h, id) of buckets with more than one, and n, how many there are."""
    # counted and written apart from the join, so that Spark can split a hot bucket's part of it
    sizes = common.cut(buckets.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    return common.cut(buckets.join(sizes, "h"))


def classes(buckets: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(id, label): what the links between similar members (h, id, n) of buckets connect; members without links are left out.

    Comparing all members with each other would grow with the square of a bucket. Instead one of them, the one that
    shares the most bands with others, such as the original of many copies, becomes the centre, and all are compared with
    it; those unlike it are compared with any other one, picked by hash. Members of a bucket that these links don't
    connect are then compared in blocks, so that in the end all pairs of a bucket are compared or connected.
    """
    shared = buckets.groupBy("id").agg(F.sum("n").alias("shared"))
    most = buckets.select("h", "id").join(shared, "id").groupBy("h").agg(F.max(F.struct("shared", (-F.col("id")).alias("c"))).alias("m")).select("h", (-F.col("m.c")).alias("b"))
    any_ = buckets.where("n > 2").groupBy("h").agg(F.max(F.struct(F.xxhash64("h", "id"), "id")).alias("m")).select("h", F.col("m.id").alias("b"))
    left, links = buckets.select("h", "id"), []
    for centres in (most, any_):
        # written apart from the join, so that Spark can split a hot bucket's part of it
        paired = left.join(common.cut(centres), "h").where("id <> b").select("h", F.col("id").alias("a"), "b")
        pairs = common.cut(paired.select("a", "b").distinct())
        links.append(common.cut(similar(pairs, sets, least)))
        left = paired.join(links[-1], ["a", "b"], "left_anti").select("h", F.col("a").alias("id"))
    label = components(links[0].union(links[1]))
    more = between(buckets.where("n > 2").select("h", "id"), label, sets, least)  # a pair alone has been compared
    return label if more.isEmpty() else components(label.select(F.col("id").alias("a"), F.col("label").alias("b")).union(more))


def likely(sets: DataFrame, label: DataFrame, least: float) -> DataFrame:
    """(id): documents with one of their rarest shingles in a document of another label.

    With shingles in one order, the first of which are at most (1 - least) of a set and one more, similar sets share
    one of these. Rare ones come first, by counts in slots: what documents have from a frequent passage isn't looked at.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for s in batch.column(1):
                total += np.bincount(np.frombuffer(s.as_buffer(), np.uint32) % SLOTS, minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    counts = sets.mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    table = np.zeros(SLOTS, np.int64)
    table[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(table)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for s in batch.column(1):
                s = np.frombuffer(s.as_buffer(), np.uint32)
                first = int((1 - least) * s.size + 1e-6) + 1
                out.append(s[np.lexsort((s, sent.value[s % SLOTS]))[:first]].astype(np.int64))
                n.append(len(out[-1]))
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), flat], ["id", "t"])

    tokens = common.cut(sets.mapInArrow(rarest, "id long, t long").join(label, "id", "left").select("id", "t", F.coalesce("label", "id").alias("label")))
    mixed = common.cut(tokens.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("t"))
    return tokens.join(mixed, "t", "left_semi").select("id").distinct()


def between(members: DataFrame, label: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between labels, from all pairs of members (h, id) of a bucket with unlike labels.

    Members of a bucket's most frequent label need not meet each other: the others meet all, in blocks, and a block
    gives no more links than it has labels.
    """

    def unlike(rows: DataFrame) -> DataFrame:
        """Members of buckets with two labels and more; main: the most frequent label; x, y: parts of others and of all."""
        counts = rows.groupBy("h", "label").agg(F.count("*").alias("n"))
        main = counts.groupBy("h").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n")).where("n > m.n")
        parts = (F.ceil(c / BLOCK).cast("int").alias(k) for c, k in ((F.col("n") - F.col("m.n"), "x"), (F.col("n"), "y")))
        return common.cut(rows.join(common.cut(main.select("h", F.col("m.label").alias("main"), *parts)), "h"))

    rows = unlike(common.cut(members.join(label, "id", "left").select("h", "id", F.coalesce("label", "id").alias("label"))))
    if rows.isEmpty():
        return members.sparkSession.createDataFrame([], "a long, b long")
    held = common.cut(sets.join(rows.select("id").distinct(), "id", "left_semi"))
    rows = unlike(rows.join(common.cut(likely(held, label, least)), "id", "left_semi").select("h", "id", "label"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = rows.where("label <> main").select("h", "id", "label", F.lit(False).alias("all"), block("x").alias("i"), every("y").alias("j"))
    all_ = rows.select("h", "id", "label", F.lit(True).alias("all"), block("y").alias("j"), every("x").alias("i"))
    blocks = others.unionByName(all_).join(held, "id")

    def joined(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[~block["all"]], block[block["all"]]
        names, of = np.unique(block["label"].to_numpy(), return_inverse=True)
        x, y = of[~block["all"].to_numpy()], of[block["all"].to_numpy()]
        near = similar_sets(left["s"], right["s"], least) & (x[:, None] != y)
        a, b = np.nonzero(near)
        low = np.arange(names.size)
        while True:  # the least label that links lead to
            new = low.copy()
            np.minimum.at(new, x[a], low[y[b]])
            np.minimum.at(new, y[b], new[x[a]])
            if (new == low).all():
                break
            low = new
        at = np.flatnonzero(low != np.arange(names.size))
        return pd.DataFrame({"a": names[at], "b": names[low[at]]})

    return common.cut(blocks.groupBy("h", "i", "j").applyInPandas(joined, "a long, b long").distinct())


def similar_sets(left: pd.Series, right: pd.Series, least: float) -> np.ndarray:
    """Which sets of the one side and of the other have a Jaccard similarity of at least `least`."""
    sides = [[np.frombuffer(s, np.uint32) for s in side] for side in (left, right)]
    sizes = [np.array([s.size for s in side], np.float32) for side in sides]
    flat = [np.concatenate([np.zeros(0, np.uint32), *side]) for side in sides]
    both = np.intersect1d(*flat)  # elements of one side alone are in no intersection
    total = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    at = []
    for side, f in zip(sides, flat, strict=True):
        column = np.minimum(np.searchsorted(both, f), max(0, both.size - 1))
        here = both[column] == f if both.size else np.zeros(f.size, bool)
        at.append((np.repeat(np.arange(len(side)), [s.size for s in side])[here], column[here]))
    for first in range(0, both.size, COLUMNS):
        parts = []
        for side, (row, column) in zip(sides, at, strict=True):
            part = np.zeros((len(side), min(COLUMNS, both.size - first)), np.float32)
            inside = (column >= first) & (column < first + COLUMNS)
            part[row[inside], column[inside] - first] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    union = sizes[0][:, None] + sizes[1] - total
    return (union > 0) & (total >= least * union - 1e-3)


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id that links (a, b) lead to, by alternating large and small stars."""

    def fingerprint(edges: DataFrame) -> Row:
        return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()

    edges = common.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = fingerprint(edges)
    while True:
        # large star: what is above u goes to the least neighbour of u
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what is below u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        edges = common.cut(small)
        before, seen = seen, fingerprint(edges)
        if seen == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, weighted: bool = False) -> DataFrame:
    """(key, class_id): a class holds the documents that links of similarity `least` or more connect; its id is its least key.

    Similarity: Jaccard, of the sets of five-word shingles (all words, if a text has fewer), or, if weighted, of how often
    a text has each. The key is an integer (others that Spark can't cast raise). Texts with the same words are copies of each other; texts without words are copies only of equal texts. Null and empty texts are classes of
    their own. Rows without a key get a null class. Rows that share a key count as one
    document, alike to all that any of its texts is alike to; each row is returned.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known = common.cut(summaries(docs, key, text, weighted))
    # each distinct text has a number of its own, so that a key may have several texts
    first = known.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    first = common.cut(first.withColumn("node", F.monotonically_increasing_id()))
    buckets = crowded(first.select(F.explode("bands").alias("h"), F.col("node").alias("id")).distinct())
    involved = common.cut(first.select("rep", "k1", "k2", "node").join(buckets.select(F.col("id").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("rep", "id"))
    sets = shingle_sets(rows.join(involved.select("id").distinct(), "id", "left_semi"), weighted)
    sets = common.cut(sets.dropDuplicates(["id", "k1", "k2"]).join(involved, ["id", "k1", "k2"]).select(F.col("node").alias("id"), "s"))
    label = classes(buckets, sets, least)
    # texts of one key are in one class
    unlike = F.max(F.col("k1")) > F.min("k1"), F.max(F.col("k2")) > F.min("k2")
    texts = known.groupBy("id").agg((unlike[0] | unlike[1]).alias("several")).where("several").select("id")
    held = common.cut(known.select("id", "k1", "k2").join(texts, "id", "left_semi").join(first.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "node").distinct())
    if not held.isEmpty():
        alike = held.join(held.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b")
        label = components(label.select(F.col("id").alias("a"), F.col("label").alias("b")).union(alike))
    nodes = first.select("k1", "k2", "rep", "node").join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_of = nodes.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = common.cut(nodes.join(least_of, "label").select("k1", "k2", "class_id"))
    of = known.select("id", "k1", "k2").join(named, ["k1", "k2"]).groupBy("id").agg(F.min("class_id").alias("class_id"))
    return rows.select("id").join(of, "id", "left").select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"))
