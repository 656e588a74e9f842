"""Repeated byte strings across documents, by suffix arrays over shards of text.

A string of `least` bytes that occurs twice has, at either place, the same least-hashed 40-byte gram: its anchor.
Anchors met once in the corpus therefore need no further look. Around each of the others, the bytes that a string
with this anchor can cover are cut out, equal cuts are counted together, and the cuts of an anchor meet in one shard.
A shard's suffixes are sorted by refinement of groups (Larsson and Sadakane), common prefixes follow in text order
(Kasai), and neighbours that share `least` bytes are repeats. An anchor with more cuts than a shard takes is dealt to
several shards, and each looks the other's strings up in its suffix array by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .dart_minhash import _RANDOM, _powers

GRAM = 40
#: Cuts in a shard, about, and at most of one anchor.
SHARD_CUTS = 3_000
BASE = 0x5851F42D4C957F2D
#: Bits of a place within a slice of text; longer slices than this are refused. Where a row's own bits begin above it.
PLACE_BITS, OWN_BIT = 30, 48
#: Anchors with more cuts have a shard of their own: sums of small numbers alone stay near their mean.
OWN_CUTS = 100
#: Bits of a text position that are sorted together with what they are sorted by; longer texts are sorted by places.
BITS = 21


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Hash and place of each anchor, the first and last window of `least` bytes that it anchors, and the cut's hash.

    A window's anchor is the leftmost of its grams with the least (upper bits of the) hash, so equal windows have
    equal anchors at equal distance. The cut runs from the first window's start to the last one's end.
    """
    none = np.zeros(0, np.int64)
    n, width = data.size - GRAM + 1, least - GRAM + 1
    if data.size >= 1 << PLACE_BITS:
        raise ValueError(f"a text has {data.size} bytes")
    starts = np.flatnonzero(np.arange(data.size) + least <= np.repeat(offsets[1:], np.diff(offsets)))
    if not starts.size:
        return (none,) * 5
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[data] * _powers(BASE, data.size), dtype=np.uint64)])
    back = _powers(pow(BASE, -1, 1 << 64), n)
    h = common.mix((total[GRAM:] - total[:-GRAM]) * back)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    # least of each window of `width` grams: of a block's rest and the next block's beginning; places break ties
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:n] = (h & ~mask) | np.arange(n, dtype=np.uint64)
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    place = (np.minimum(ahead[starts], behind[starts + width - 1]) & mask).astype(np.int64)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    first, last = starts[new], starts[np.concatenate([new[1:], [True]])]
    place = place[new]
    cut = common.mix((total[last + least] - total[first]) * back[first]) ^ common.mix(((last - first) << 8 | (place - first)).astype(np.uint64))
    return h[place], place, first, last, cut


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of the text in order; the common prefixes rely on its being complete."""
    n = text.size
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = key << np.uint64(8) | padded[k : k + n]
    mask, fits = np.uint64((1 << BITS) - 1), n < 1 << BITS
    if n >= 1 << 31:
        raise ValueError(f"a shard's text has {n} bytes")
    if fits:
        packed = np.sort(key << np.uint64(BITS) | np.arange(n, dtype=np.uint64))
        order, head = (packed & mask).astype(np.int64), packed >> np.uint64(BITS)
    else:
        order = np.argsort(key, kind="stable")
        head = key[order]
    new = np.concatenate([[True], head[1:] != head[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = first + 1  # 0 is what lies beyond the end
    h = 5
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~alone)
        if not at.size:
            break
        place = order[at]
        if fits:
            packed = np.sort(rank[place].astype(np.uint64) << np.uint64(2 * BITS) | rank[np.minimum(place + h, n)].astype(np.uint64) << np.uint64(BITS) | place.astype(np.uint64))
            place, head = (packed & mask).astype(np.int64), packed >> np.uint64(BITS)
        else:
            both = rank[place] * (n + 1) + rank[np.minimum(place + h, n)]
            by = np.argsort(both, kind="stable")
            place, head = place[by], both[by]
        order[at] = place
        new[at] = np.concatenate([[True], head[1:] != head[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[place] = first[at] + 1
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """Bytes, up to `most`, that each suffix shares with the one before it in order; many stretches of text in step."""
    n = text.size
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    out, padded = np.zeros(n, np.int32), np.concatenate([text, np.zeros(most + 1, np.uint8)])
    at = np.arange(0, n, lane)
    end, same = np.minimum(at + lane, n), np.zeros(at.size, np.int64)
    while at.size:
        other = before[at]
        longer = (other >= 0) & (same < most) & (np.maximum(at, other) + same < n)
        longer &= padded[at + same] == padded[np.maximum(other, 0) + same]
        same += longer
        done = np.flatnonzero(~longer)
        out[at[done]] = np.where(other[done] >= 0, same[done], 0)
        same[done] = np.maximum(same[done] - 1, 0)
        at[done] += 1
        if (at[done] >= end[done]).any():
            keep = at < end
            at, end, same = at[keep], end[keep], same[keep]
    return out[order]


def windows_of(sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Place in the joined text, and cut, of every window of `least` bytes inside one cut."""
    n = np.maximum(sizes - least + 1, 0)
    cut = np.repeat(np.arange(sizes.size), n)
    return (np.cumsum(sizes) - sizes)[cut] + np.arange(n.sum()) - (np.cumsum(n) - n)[cut], cut


def in_shard(cuts: list[bytes], anchor: np.ndarray, before: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(cut, start in it) of the windows that occur twice at one distance from their anchor."""
    sizes = np.array([len(c) for c in cuts])
    text = np.frombuffer(b"".join(cuts), np.uint8)
    place, cut = windows_of(sizes, least)
    if not place.size:
        return cut, place
    order = suffix_array(text)
    group = np.zeros(text.size, np.int64)
    group[order] = np.cumsum(common_prefixes(text, order, least) < least)
    start = place - (np.cumsum(sizes) - sizes)[cut]
    _, number = np.unique(anchor, return_inverse=True)
    key = (group[place] * (number.max() + 1) + number[cut]) * (2 * least) + start - before[cut] + least
    _, which = np.unique(key, return_inverse=True)
    twice = np.bincount(which, count[cut])[which] >= 2
    return cut[twice], start[twice]


def across(left: list[bytes], right: list[bytes], left_before: np.ndarray, right_before: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cut, start) of the windows of either shard that the other has too, looked up in its suffix array."""
    sides = []
    for cuts, before in ((left, left_before), (right, right_before)):
        sizes = np.array([len(c) for c in cuts])
        text = np.frombuffer(b"".join(cuts), np.uint8)
        place, cut = windows_of(sizes, least)
        start = place - (np.cumsum(sizes) - sizes)[cut]
        sides.append((text, place, cut, start, start - before[cut]))
    out = []
    for (text, place, cut, start, away), (text2, place2, cut2, start2, away2) in (sides, sides[::-1]):
        hit = np.zeros(place.size, bool)
        if place.size and place2.size:
            order = suffix_array(text2)
            inside = np.zeros(text2.size, bool)
            inside[place2] = True
            order = order[inside[order]]
            of = np.zeros(text2.size, np.int64)
            of[place2] = away2
            views, views2 = sliding_window_view(text, least), sliding_window_view(text2, least)
            sorted_ = np.ascontiguousarray(views2[order]).view(f"S{least}").reshape(-1)
            # among equal strings, distances from the anchor are looked through by set membership
            names = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            known = np.unique(names * (4 * least) + of[order])
            for k in range(0, place.size, 50_000):
                want = np.ascontiguousarray(views[place[k : k + 50_000]]).view(f"S{least}").reshape(-1)
                at = np.minimum(np.searchsorted(sorted_, want), order.size - 1)
                equal = (views2[order[at]] == views[place[k : k + 50_000]]).all(axis=1)
                hit[k : k + 50_000] = equal & np.isin(names[at] * (4 * least) + away[k : k + 50_000], known)
        out.append((cut[hit], start[hit]))
    return out


def runs(start: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Bytes that windows with these starts cover, as maximal runs."""
    if not start.size:
        return []
    start = np.unique(start)
    gap = np.flatnonzero(np.diff(start) > least) + 1
    return [(int(p[0]), int(p[-1]) + least) for p in np.split(start, gap)]


def row_hash(key: str, text: str) -> tuple[Column, Column]:
    """64 and 15 bits that stand for a row; rows with equal bits are taken for copies of each other."""
    return F.xxhash64(key, text), F.xxhash64(text, F.lit(1), key).bitwiseAND(0x7FFF)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200) -> DataFrame:
    """(h, g, spans): for each row_hash with any, the maximal runs of bytes (start, end) that repeated strings cover.

    Rows that are wholly equal count as so many places. Nothing crosses a text's end; null is empty.
    """
    h, g = row_hash(key, text)
    rows = docs.select(h.alias("h"), F.col(text).alias("text"), g.alias("g")).where(f"octet_length(text) >= {least}")

    def found(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            data, offsets = common.utf8(batch.column(1))
            h, place, first, last, cut = anchors(data, offsets, least)
            a = pa.array(h.view(np.int64))
            if not whole:
                yield pa.RecordBatch.from_arrays([a], ["a"])
                continue
            row = np.searchsorted(offsets, place, side="right") - 1
            own = batch.column(2).to_numpy()[row] << OWN_BIT
            packed = own | (place - offsets[row]) << 16 | (place - first) << 8 | (last - place + least - GRAM)
            yield pa.RecordBatch.from_arrays([a, pa.array(cut.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(packed)], ["a", "c", "h", "at"])

    # two scans, the first for the anchors alone: cheaper than keeping all places of anchors met once
    # written, so that Spark can split what it joins: one anchor may have a third of all places
    often = common.cut(rows.mapInArrow(lambda x: found(x, False), "a long").groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select("a"))
    flagged = common.cut(rows.mapInArrow(lambda x: found(x, True), "a long, c long, h long, at long").join(often, "a"))
    equal = flagged.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("h", "at")).alias("one"))
    unlike = equal.groupBy("a").agg(F.count("*").alias("m"))
    equal = common.cut(equal.join(unlike, "a"))
    # an anchor with one cut, met several times: all of it is repeated; cuts that differ are compared below
    same = equal.where("m = 1").select("a", "c", F.col("one.at").alias("at"))
    same = same.select("a", "c", (-F.shiftright("at", 8).bitwiseAND(255)).cast("int").alias("low"), (F.col("at").bitwiseAND(255) + GRAM).cast("int").alias("high"))
    own = F.shiftright("one.at", OWN_BIT).alias("g")
    places = equal.where("m > 1").groupBy("one.h", own).agg(F.collect_list(F.struct("a", "c", "n", "m", F.col("one.at").alias("at"))).alias("places"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            data, offsets = common.utf8(batch.column(1))
            raw, lists = data.tobytes(), batch.column(2)
            flat = lists.flatten()
            at = flat.field("at").to_numpy()
            begin = offsets[:-1][np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())] + (at >> 16 & (1 << OWN_BIT - 16) - 1)
            before, after = at >> 8 & 255, (at & 255) + GRAM
            cuts = [raw[s:e] for s, e in zip((begin - before).tolist(), (begin + after).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in "acnm"), pa.array(before.astype(np.int32)), pa.array(cuts, pa.binary())], ["a", "c", "n", "m", "before", "cut"])

    texts = rows.join(places, ["h", "g"]).select("h", "text", "places")
    distinct = texts.mapInArrow(cut_out, "a long, c long, n long, m long, before int, cut binary")
    shards = max(1, equal.where(f"m > 1 and m <= {OWN_CUTS}").count() // SHARD_CUTS)
    parts = F.ceil(F.col("m") / SHARD_CUTS).cast("int")
    part = F.pmod(F.col("c"), parts).cast("int")
    hot = F.col("m") > SHARD_CUTS
    dealt = distinct.select("*", part.alias("part"), F.explode(F.when(hot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))).alias("other"))
    shard = F.when(hot, F.concat_ws(":", "a", F.least("part", "other"), F.greatest("part", "other")))
    shard = shard.when(F.col("m") > OWN_CUTS, F.concat(F.lit("own"), F.col("a"))).otherwise(F.pmod("a", F.lit(shards)).cast("string"))
    dealt = dealt.select("a", "c", "n", "before", "cut", shard.alias("shard"), (hot & (F.col("part") > F.col("other"))).cast("int").alias("side"))

    def judged(shard: pd.DataFrame) -> pd.DataFrame:
        # equal rows have given their cuts several times
        shard = shard.drop_duplicates(["a", "c", "side"]).sort_values(["a", "c"], ignore_index=True)
        pair = shard["shard"].iloc[0].split(":")
        if len(pair) == 3 and pair[1] != pair[2]:
            sides = [shard[shard["side"] == k].reset_index(drop=True) for k in (0, 1)]
            hits = across(*(s["cut"].tolist() for s in sides), *(s["before"].to_numpy() for s in sides), least)
        else:
            sides = [shard]
            hits = [in_shard(shard["cut"].tolist(), shard["a"].to_numpy(), shard["before"].to_numpy(), shard["n"].to_numpy(), least)]
        out = []
        for side, (cut, start) in zip(sides, hits, strict=True):
            bounds = np.flatnonzero(np.diff(cut)) + 1
            for rows_of, starts in zip(np.split(cut, bounds), np.split(start, bounds), strict=True):
                if rows_of.size:
                    i = rows_of[0]
                    out += [(side["a"][i], side["c"][i], s - side["before"][i], e - side["before"][i]) for s, e in runs(starts, least)]
        return pd.DataFrame(out, columns=["a", "c", "low", "high"])

    compared = dealt.groupBy("shard").applyInPandas(judged, "a long, c long, low int, high int")
    start = F.shiftright("at", 16).bitwiseAND((1 << OWN_BIT - 16) - 1).cast("int")
    placed = flagged.join(same.unionByName(compared), ["a", "c"]).select("h", F.shiftright("at", OWN_BIT).alias("g"), F.struct((start + F.col("low")).alias("start"), (start + F.col("high")).alias("end")).alias("span"))
    return placed.groupBy("h", "g").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200) -> DataFrame:
    """(key, n_bytes, spans, kept): what stays of each document as bytes, and the removed runs of bytes (start, end).

    Each byte goes that a string of `least` bytes covers which also starts anywhere else, in this document or another;
    overlapping occurrences count, and strings are judged on the input. Null counts as empty; shorter texts stay whole.
    Rows that are equal in key and text are copies of each other: both go. Null keys are allowed.
    """
    h, g = row_hash(key, text)
    rows = docs.select(F.col(key).alias("id"), h.alias("h"), g.alias("g"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.join(repeated(docs, key, text, least), ["h", "g"], "left")
    rows = rows.select("id", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            kept, all_spans, sizes = [], [], []
            for t, given in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "replace")
                merged = united([(s["start"], s["end"]) for s in given])
                edges = [0, *(x for span in merged for x in span), len(raw)]
                kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                all_spans.append([{"start": s, "end": e} for s, e in merged])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"])

    return rows.mapInArrow(removed, f"{key} {dict(rows.dtypes)['id']}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
