"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are vocabulary strings that byte-pair encoding would turn into exactly one token. Which
strings those are is proved once, before any text is read: every vocabulary string is merged alone and kept only if
one token results. Counting then looks pre-tokens up and merges only the rest.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Merged pre-tokens that a Python worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Bytes of the longest pre-tokens that are merged together with others.
LONGEST = 40
#: Slots of the table of merges, as a power of two; what a pair without a merge has for a rank.
SLOT_BITS, NONE = 19, 1 << 30
#: The vocabulary travels to the executors; a larger file than this is refused.
MOST_VOCABULARY_BYTES = 64 << 20
#: White space of Unicode, as the pattern engine of the vocabulary's library sees it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Case pairs of Unicode 16, which the library's tables have and Python's have not.
NEW_CASES = (("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"))
#: Letters of a later Unicode than the library's, which are no letters to it: as a range of a class in a pattern.
LATER = "\U000323b0-\U0003ffff"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """Counts tokens as a word-end byte-pair vocabulary (file of the tokenizers library) gives them."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("only lower-casing byte-pair vocabularies with word ends are supported")
        self.end = model["end_of_word_suffix"]
        self.rank = {(a, b): i for i, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.vocabulary = model["vocab"]
        special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with strip or word flags are not supported")
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pattern = pattern.replace(r"[^\s", f"[^{SPACE}")
        if r"[\p{L}]+" not in pattern or r"\p{L}\p{N}]+" not in pattern:
            raise ValueError("only patterns with runs of letters and of other signs are supported")
        self.pattern, self.later = regex.compile(pattern), re.compile(f"[{LATER}]")
        other = f"[^{SPACE}" + r"\p{L}\p{N}]"
        self.slower = regex.compile(pattern.replace(other + "+", f"(?:{other}|[{LATER}])+").replace(r"[\p{L}]+", f"(?:(?![{LATER}])" + r"\p{L})+"))
        self.letters = byte_letters()
        self.numbered()
        self.whole: frozenset[str] = self.proved()
        self.known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def numbered(self) -> None:
        """Symbols as numbers, and an open-addressed table from pairs of them to ranks."""
        number: dict[str, int] = {}
        for symbol in [*self.letters, *(c + self.end for c in self.letters), *self.vocabulary, *(s for pair in self.rank for s in (*pair, "".join(pair)))]:
            number.setdefault(symbol, len(number))
        self.letter = np.array([[number[c], number[c + self.end]] for c in self.letters], np.int32)
        self.counts = np.array([s in self.vocabulary for s in number])
        keys = np.array([number[a] << 20 | number[b] for a, b in self.rank], np.int64)
        self.result = np.array([number[a + b] for a, b in self.rank], np.int32)
        self.key, self.rank_of = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, NONE, np.int32)
        todo, self.probes = np.arange(keys.size), 0
        while todo.size:
            slot = (self.slot(keys[todo]) + self.probes) & (self.key.size - 1)
            free = np.flatnonzero(self.key[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.rank_of[slot[put]] = keys[todo[put]], todo[put]
            todo = np.delete(todo, put)
            self.probes += 1

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE where they don't merge."""
        keys = a.astype(np.int64) << 20 | b
        slot = self.slot(keys)
        out = np.where(self.key[slot] == keys, self.rank_of[slot], NONE)
        left = np.flatnonzero((out == NONE) & (self.key[slot] != -1))
        for k in range(1, self.probes):
            at = (slot[left] + k) & (self.key.size - 1)
            same = self.key[at] == keys[left]
            out[left[same]] = self.rank_of[at[same]]
            left = left[~same & (self.key[at] != -1)]
            if not left.size:
                break
        return out

    def proved(self) -> frozenset[str]:
        """Pre-tokens that encode alone as one token: every vocabulary string with a word end, merged and compared."""
        back = {c: b for b, c in enumerate(self.letters)}
        out = set()
        for piece in self.vocabulary:
            if piece.endswith(self.end) and (body := piece[: -len(self.end)]):
                try:
                    word = bytes(map(back.__getitem__, body)).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if self.merged(word) == [piece]:
                    out.add(word)
        return frozenset(out)

    def merged(self, word: str) -> list[str]:
        """Merges of one pre-token: the pair of least rank first, the leftmost of equals."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        rank = self.rank
        if len(parts) > 48:
            return self.merged_long(parts)
        while len(parts) > 1:
            ranks = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == 1 << 30:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [p for p in parts if p in self.vocabulary]

    def merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap: n log n for pre-tokens of any length."""
        n, rank = len(parts), self.rank
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or parts[i] != a or (j := after[i]) >= n or parts[j] != b:
                continue
            parts[i] = a + b
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, live in zip(parts, alive, strict=True) if live and p in self.vocabulary]

    def merged_all(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each of many short words: all words do one merge after the other, in step."""
        rows, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        inside = np.arange(width) < size[:, None]
        raw = np.zeros((rows, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.letter[raw, 0]
        symbol[np.arange(rows), size - 1] = self.letter[raw[np.arange(rows), size - 1], 1]
        rank = np.full((rows, width), NONE, np.int32)
        both = inside[:, 1:]
        rank[:, :-1][both] = self.ranks(symbol[:, :-1][both], symbol[:, 1:][both])
        out, every, column = np.zeros(rows, np.int64), np.arange(rows), np.arange(width - 1)
        while every.size:
            at = rank.argmin(axis=1)
            k = np.arange(every.size)
            least = rank[k, at]
            over = least == NONE
            if over.any():
                out[every[over]] = (self.counts[symbol[over]] & (np.arange(symbol.shape[1]) < size[over][:, None])).sum(axis=1)
                keep = ~over
                every, at, least, symbol, rank, size = every[keep], at[keep], least[keep], symbol[keep], rank[keep], size[keep]
                if not every.size:
                    break
                k = np.arange(every.size)
            symbol[k, at] = self.result[least]
            # what stands after the merged pair moves up by one
            moved = np.where(column > at[:, None], 1, 0) + column
            symbol[:, :-1] = np.take_along_axis(symbol, moved, axis=1)
            rank[:, :-1] = np.take_along_axis(rank, moved, axis=1)
            rank[:, -1] = NONE
            size -= 1
            right = at + 1 < size
            rank[k, at] = NONE
            rank[k[right], at[right]] = self.ranks(symbol[k[right], at[right]], symbol[k[right], at[right] + 1])
            left = at > 0
            rank[k[left], at[left] - 1] = self.ranks(symbol[k[left], at[left] - 1], symbol[k[left], at[left]])
        return out

    def learn(self, words: set[str]) -> None:
        """Remembers the counts of pre-tokens that are no whole tokens."""
        short = sorted(((w.encode(), w) for w in words), key=lambda x: len(x[0]))
        long = [(raw, w) for raw, w in short if len(raw) > LONGEST]
        short = short[: len(short) - len(long)]
        for i in range(0, len(short), 8_000):
            part = short[i : i + 8_000]
            self.known.update(zip((w for _, w in part), self.merged_all([raw for raw, _ in part]).tolist(), strict=True))
        self.known.update((w, len(self.merged(w))) for _, w in long)

    def pre_tokens(self, text: str) -> list[str]:
        # each capital sigma is lowered by itself, without the rule for word ends
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        for capital, small in NEW_CASES:
            text = text.replace(capital, small)
        text = text.lower()
        return (self.pattern if text.isascii() or not self.later.search(text) else self.slower).findall(text)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if not self.whole <= self.known.keys() or len(self.known) > REMEMBERED + len(self.whole):
            self.known = dict.fromkeys(self.whole, 1)
        parts = [self.special.split(t) if self.special else [t] for t in texts]
        found = [list(chain.from_iterable(map(self.pre_tokens, p))) for p in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n = np.fromiter(map(self.known.get, chain.from_iterable(found), repeat(-1)), np.int64, int(sizes.sum()))
        new = np.flatnonzero(n < 0)
        if new.size:
            row = np.searchsorted(np.cumsum(sizes), new, side="right")
            words = [found[i][j] for i, j in zip(row.tolist(), (new - (np.cumsum(sizes) - sizes)[row]).tolist(), strict=True)]
            self.learn(set(words))
            n[new] = np.fromiter(map(self.known.__getitem__, words), np.int64, new.size)
            for word in {w for w in words if len(w) > LONGEST}:  # rare, and too large to keep
                del self.known[word]
        total = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        return np.diff(total) + np.fromiter(map(len, parts), np.int64, len(parts)) - 1


def load(path: str) -> WordBpe:
    with open(path, "rb") as file:
        raw = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(raw) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes")
    return WordBpe(json.loads(raw))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (boolean) to docs; columns of these names are replaced.

    vocabulary: path of the file on the driver, which sends the vocabulary (of checked size) to the executors. Null
    text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are one token each. No text is cut.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    sent = spark.sparkContext.broadcast(load(vocabulary))
    schema = common.plus(docs, "n_tokens long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent.value
        for batch in common.slices(batches, text):
            counts = pa.array(bpe.count([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], [*batch.schema.names, "n_tokens"])

    out = docs.mapInArrow(counted, schema)
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return out.withColumns({"n_bytes": n_bytes, "over_limit": F.col("n_tokens") > limit})
