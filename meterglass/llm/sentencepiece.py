"""SentencePiece encoding and decoding: the unigram model's best segmentation over a double-array trie of pieces.

Spaces become the marker U+2581 and one marker is put before a text. No piece has a marker after another character,
so a text falls apart, without loss, at every marker that follows another character: the best path of a text is the
best paths of these chunks, one after the other. Chunks that are met again are looked up; new ones of a batch go
through the trie together, one byte position at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

MARKER = "▁"
CHUNK = re.compile(r" *[^ ]+| +")
#: What an unknown character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks that a Python worker remembers before it starts afresh, and bytes of the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: Pieces, about, that are turned back into text at once.
MOST_IDS = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class DoubleArray:
    """A trie of byte strings in two arrays: state s has child b at t = base[s] + b if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0], low, todo = True, 1, [(0, tree)]
        while todo:
            state, node = todo.pop()
            self.value[state] = node.get(-1, -1)
            if not (edges := np.array(sorted(b for b in node if b >= 0), np.int64)).size:
                continue
            at = self.room(used, edges, low)
            if at + 1024 > used.size:
                self.base, self.check, self.value = (np.concatenate([x, np.full(x.size, fill, x.dtype)]) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
                used = np.concatenate([used, np.zeros(used.size, bool)])
            # slots before `low` are nearly all taken: new states seek room after it
            low = max(low, at + int(edges[0]) - 2048)
            self.base[state] = at
            used[at + edges] = True
            self.check[at + edges] = state
            todo += [(at + int(b), node[b]) for b in edges]
        end = int(np.flatnonzero(used)[-1]) + 257
        self.base, self.check, self.value = (np.concatenate([x, np.full(512, -1, np.int32)])[:end] for x in (self.base, self.check, self.value))

    @staticmethod
    def room(used: np.ndarray, edges: np.ndarray, low: int) -> int:
        """The first base at which the slots of all edges are free."""
        width = 1024
        while True:
            used = np.concatenate([used, np.zeros(max(0, low + width + 512 - used.size), bool)])
            free = low + np.flatnonzero(~used[low : low + width]) - edges[0]
            free = free[free >= 0]
            fits = ~used[free[:, None] + edges].any(axis=1)
            if fits.any():
                return int(free[np.argmax(fits)])
            low += width

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """End and value of every key that begins at start."""
        state, base, check, value = 0, self.base, self.check, self.value
        for i in range(start, len(text)):
            child = base[state] + text[i]
            if check[child] != state:
                return
            state = child
            if value[state] >= 0:
                yield i + 1, int(value[state])


class Speller:
    """Turns pieces back into text: markers are spaces, byte pieces are joined to characters, the marker put first goes."""

    def __init__(self, bytes_of: list[bytes]):
        self.flat = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.sizes = np.array([len(b) for b in bytes_of], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def texts(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The text of each list ids[edges[i] : edges[i + 1]]; bytes that are no characters become U+FFFD."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        data = self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if ends.size else 0)]
        at = np.concatenate([[0], ends])[edges]
        filled = np.flatnonzero(np.diff(at))
        marked = at[filled[data[at[filled]] == 32]]
        data = np.delete(data, marked)
        at = at - np.searchsorted(marked, at)
        raw = data.tobytes()
        try:
            raw.decode()
            whole = not (data[at[at < data.size]] & 0xC0 == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.StringArray.from_buffers(at.size - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        """pieces: string, log score and kind of each id."""
        self.kinds = np.array([k for _, _, k in pieces])
        usable = {p.encode(): i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER) and p}
        if any(MARKER in p.lstrip(MARKER) for p, _, k in pieces if k in (NORMAL, USER)):
            raise ValueError("a piece has the space marker after another character")
        if (self.kinds == USER).any():
            raise ValueError("user-defined pieces are not supported")
        self.trie = DoubleArray(usable)
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown_score = self.score[self.kinds == NORMAL].min() - UNKNOWN_PENALTY
        byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        if len(byte) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARKER, " ").encode() if k == NORMAL else b"" for p, _, k in pieces]
        self.speller = Speller(self.bytes_of)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.sizes, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __getstate__(self) -> dict:
        kept = dict(self.__dict__)
        self.forget()
        kept |= {k: self.__dict__[k] for k in ("index", "flat", "sizes", "starts")}
        return kept

    def best(self, chunk: bytes) -> list[int]:
        """Best path of one chunk of any length."""
        n = len(chunk)
        total, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            if chunk[i] & 0xC0 == 0x80:
                continue
            after = i + 1
            while after < n and chunk[after] & 0xC0 == 0x80:
                after += 1
            single = False
            for end, piece in self.trie.prefixes(chunk, i):
                single |= end == after
                if (s := total[i] + self.score[piece]) > total[end]:
                    total[end], back[end] = s, (i, piece)
            if not single and (s := total[i] + self.unknown_score) > total[after]:
                total[after], back[after] = s, (i, -1)
        out: list[int] = []
        while n:
            i, piece = back[n]
            out += [piece] if piece >= 0 else [int(self.byte[b]) for b in reversed(chunk[i:n])]
            n = i
        return out[::-1]

    def best_of_all(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of chunks of at most LONGEST bytes and their sizes: one numpy pass for each start and depth."""
        rows, size = len(chunks), np.array([len(c) for c in chunks])
        width = int(size.max())
        text = np.zeros((rows, width), np.uint8)
        text[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(chunks), np.uint8)
        total = np.full((rows, width + 1), -np.inf)
        total[:, 0] = 0
        came, by = np.zeros((rows, width + 1), np.int16), np.full((rows, width + 1), -1, np.int32)
        first = (text & 0xC0) != 0x80
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        for i in range(width):
            live = np.flatnonzero((size > i) & first[:, i])
            if not live.size:
                continue
            every, here = live, total[live, i]
            lead = text[live, i]
            after = i + 1 + (lead >= 0xC0).astype(int) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(live.size, bool)
            of, state = np.arange(live.size), np.zeros(live.size, np.int32)
            for j in range(i, width):
                child = base[state] + text[live, j]
                kept = (check[child] == state) & (size[live] > j)
                if not kept.any():
                    break
                live, of, state = live[kept], of[kept], child[kept]
                piece = value[state]
                ends = np.flatnonzero(piece >= 0)
                if ends.size:
                    r, o, p = live[ends], of[ends], piece[ends]
                    single[o] |= after[o] == j + 1
                    s = here[o] + score[p]
                    better = s > total[r, j + 1]
                    r, p = r[better], p[better]
                    total[r, j + 1], came[r, j + 1], by[r, j + 1] = s[better], i, p
            lone = np.flatnonzero(~single)
            if lone.size:
                r, e = every[lone], after[lone]
                s = here[lone] + self.unknown_score
                better = s > total[r, e]
                r, e = r[better], e[better]
                total[r, e], came[r, e], by[r, e] = s[better], i, -1
        # back along the best paths, again all in step; a byte that no piece ends at stands for itself
        at, every = size.copy(), np.arange(rows)
        path, used = np.empty((rows, width), np.int32), np.zeros(rows, np.int64)
        while every.size:
            end = at[every]
            piece = by[every, end]
            start = np.where(piece >= 0, came[every, end], end - 1)
            used[every] += 1
            path[every, width - used[every]] = np.where(piece >= 0, piece, self.byte[text[every, start]])
            at[every] = start
            every = every[start > 0]
        return path[np.arange(width) >= (width - used)[:, None]], used

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in one array, and where each text's ids end."""
        if len(self.index) > REMEMBERED:
            self.forget()
        chunks = [CHUNK.findall(" " + t.replace(MARKER, " ")) if t else [] for t in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        which = np.fromiter(map(self.index.get, chain.from_iterable(chunks), repeat(-1)), np.int64, int(counts.sum()))
        missing = np.flatnonzero(which < 0)
        if missing.size:
            self.learn(set(self.at(chunks, counts, missing)))
            which[missing] = np.fromiter(map(self.index.__getitem__, self.at(chunks, counts, missing)), np.int64, missing.size)
        n = self.sizes[which]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[which] - (ends - n), n) + np.arange(ends[-1] if ends.size else 0)]
        return ids, np.concatenate([[0], ends])[np.cumsum(counts)]

    @staticmethod
    def at(chunks: list[list[str]], counts: np.ndarray, which: np.ndarray) -> Iterator[str]:
        """The chunks with these numbers."""
        text = np.searchsorted(np.cumsum(counts), which, side="right")
        within = which - (np.cumsum(counts) - counts)[text]
        return (chunks[i][j] for i, j in zip(text.tolist(), within.tolist(), strict=True))

    def learn(self, new: set[str]) -> None:
        order = sorted(((c.replace(" ", MARKER).encode("utf-8", "replace"), c) for c in new), key=lambda x: len(x[0]))
        flat, sizes = [self.flat], [self.sizes]
        short = [x for x in order if len(x[0]) <= LONGEST]
        for k in range(0, len(short), 10_000):
            ids, size = self.best_of_all([raw for raw, _ in short[k : k + 10_000]])
            flat.append(ids)
            sizes.append(size)
        for raw, _ in order[len(short) :]:
            ids = np.array(self.best(raw), np.int32)
            flat.append(ids)
            sizes.append(np.array([ids.size]))
        self.index.update(zip((c for _, c in order), range(len(self.index), len(self.index) + len(order)), strict=True))
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: list[int]) -> str:
        """The text of one list of pieces."""
        return self.speller.texts(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """Pieces, scores and kinds from a model file; whatever its trainer, the scores are taken as log scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: BYTE if model.is_byte(i) else UNKNOWN if model.is_unknown(i) else CONTROL if model.is_control(i) else UNUSED if model.is_unused(i) else NORMAL
    return Unigram([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())])


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds pieces (array of ids) to docs; a column of this name is replaced.

    model: path on the driver, which sends pieces and trie (of fixed size) to the executors. Null and empty texts have
    no pieces. Characters that no piece covers become byte pieces, so every text can be decoded.
    """
    docs = docs.drop("pieces")
    sent = docs.sparkSession.sparkContext.broadcast(load(model))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = sent.value
        for batch in common.slices(batches, text):
            ids, ends = unigram.encode([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], [*batch.schema.names, "pieces"])

    return docs.mapInArrow(encoded, common.plus(docs, "pieces array<int>"))


def decode(rows: DataFrame, model: str, pieces: str = "pieces", to: str = "decoded") -> DataFrame:
    """Adds the text that the pieces stand for; null and empty lists give an empty text. A column `to` is replaced.

    Null ids count as the unknown piece, which has no text. Lists are worked on in slices of MOST_IDS ids.
    """
    rows = rows.drop(to)
    sent = rows.sparkSession.sparkContext.broadcast(load(model).speller)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(pieces))
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for part in common.parts(batch, np.cumsum(sizes), MOST_IDS):
                lists = part.column(part.schema.get_field_index(pieces))
                ids = lists.flatten()  # without what lies under null lists
                if ids.null_count:
                    ids = pc.fill_null(ids, 0)
                edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                yield pa.RecordBatch.from_arrays([*part.columns, sent.value.texts(ids.to_numpy(zero_copy_only=False), edges)], [*part.schema.names, to])

    return rows.mapInArrow(decoded, common.plus(rows, f"{to} string"))
