"""Language of a text, in two steps: naive Bayes tells the family, then linear support vector machines the language.

A text is its character n-grams, each by the square root of its share. Families of known languages are given; another
language joins the family of the one that its n-grams resemble most, if they do enough. Within a family, one machine
for each pair of languages votes. Each machine is fitted in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import code_points

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 18
#: Texts of a language that the model is fitted on, about; n-grams that it keeps, at most.
PER_LANGUAGE, MOST_FEATURES = 1_500, 4_096
#: Languages that are learned, at most: those with the most rows.
MOST_LANGUAGES = 256
#: Least cosine of two languages' n-grams at which one whose family isn't known joins the other's.
ALIKE = 0.6
#: Cost of an error against the machine's width; passes over the texts, at most.
COST, PASSES = 4.0, 60
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms tl",
}
UNKNOWN = "und"


def grams(points: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram inside a text, and its text. ASCII other than letters counts as space."""
    p = np.where((points < 128) & ((points < 97) | (points > 122)), np.uint32(32), points)
    n = p.size - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, 2166136261 + order, np.uint32)
    blank = np.ones(n, bool)
    for k in range(order):
        h = (h ^ p[k : k + n]) * np.uint32(16777619)
        h ^= h >> np.uint32(13)
        blank &= p[k : k + n] == 32
    keep = ~blank
    for e in range(1, order):  # an n-gram that starts up to order - 1 before a text's end would cross it
        at = offsets[1:-1] - e
        keep[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(keep)
    return (h[at] & np.uint32(BUCKETS - 1)).astype(np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]


def counted(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order, buckets and texts of all n-grams."""
    points, offsets = code_points(*common.utf8(column))
    for order in ORDERS:
        yield order, *grams(points, offsets, order)


@dataclass
class Model:
    languages: list[str]
    #: Of each language.
    family: np.ndarray
    #: Number of each kept (order, bucket) plus one, 0 for the others.
    number: dict[int, np.ndarray]
    #: (n-gram, family): log of its share; and of each family's share of texts.
    log_share: np.ndarray
    prior: np.ndarray
    #: Pairs of languages, and for each the weights of n-grams and, last, the bias; above 0 for the first.
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, n-gram, count and value of the kept n-grams of each text."""
        parts, k, rows = [], len(self.log_share), len(column)
        for order, h, row in counted(column):
            total = np.bincount(row, minlength=rows)
            f = self.number[order][h]
            at = np.flatnonzero(f)
            key, n = np.unique(row[at] * k + f[at] - 1, return_counts=True)
            r, f = np.divmod(key, k)
            parts.append((r, f, n, np.sqrt(n / total[r])))
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text, and how sure that is, 0 to 1."""
        rows = len(column)
        r, f, n, v = self.features(column)
        log = np.stack([np.bincount(r, n * self.log_share[f, c], minlength=rows) + p for c, p in enumerate(self.prior)], axis=1)
        log -= log.max(axis=1, keepdims=True)
        sure = np.exp(log) / np.exp(log).sum(axis=1, keepdims=True)
        votes = np.zeros((rows, len(self.languages)))
        chance = np.zeros_like(votes)
        for (a, b), w in zip(self.pairs, self.weights, strict=True):
            p = 1 / (1 + np.exp(-np.clip(2 * (np.bincount(r, v * w[f], minlength=rows) + w[-1]), -40, 40)))
            votes[np.arange(rows), np.where(p >= 0.5, a, b)] += 1
            chance[:, a] += p
            chance[:, b] += 1 - p
        others = np.bincount(self.family)[self.family] - 1  # machines that a language takes part in
        mean = np.where(others > 0, chance / np.maximum(others, 1), 1.0)
        # most votes in the likeliest family; then the surest; then the first name
        rank = np.where(self.family == log.argmax(axis=1)[:, None], votes + mean / 2, -1)
        best = rank.argmax(axis=1)
        return best, sure[np.arange(rows), self.family[best]] * mean[np.arange(rows), best]


def families(languages: list[str], profiles: np.ndarray) -> list[str]:
    """Name of each language's family; profiles: the square roots of the shares of its n-grams."""
    known = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
    unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    out: list[str] = []
    for i, code in enumerate(languages):
        name = known.get(code.lower().replace("_", "-").split("-")[0])
        if name is None:
            alike = [(float(unit[i] @ unit[j]), -j) for j in range(len(languages)) if j < i or languages[j] in known]
            best = max(alike, default=(0.0, 0))
            near = -best[1]
            name = (out[near] if near < i else known[languages[near]]) if best[0] >= ALIKE else f"like {code}"
        out.append(name)
    return out


def machine(f: list[np.ndarray], v: list[np.ndarray], y: np.ndarray, features: int) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared errors, by dual coordinate descent."""
    rng, n = np.random.default_rng(12), len(y)
    w, alpha = np.zeros(features + 1), np.zeros(n)
    f = [np.append(i, features) for i in f]  # the bias is one more n-gram, that all have
    v = [np.append(x, 1.0) for x in v]
    curve = np.array([x @ x for x in v]) + 0.5 / COST
    for _ in range(PASSES):
        worst = 0.0
        for i in rng.permutation(n):
            g = y[i] * (w[f[i]] @ v[i]) - 1 + alpha[i] * 0.5 / COST
            step = max(alpha[i] - g / curve[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w[f[i]] += step * y[i] * v[i]
                worst = max(worst, abs(step * curve[i]))
        if worst < 1e-3:
            break
    return w


def fit(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fits the model on rows for which `usable` is true and whose text and language aren't null; None if there are none.

    Of a language's rows (MOST_LANGUAGES of them, by rows), those with the smallest hashes of their key, PER_LANGUAGE about, are learned from. To the driver
    come shares of MOST_FEATURES n-grams in each language, and the machines' weights.
    """
    spark = docs.sparkSession
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = common.cut(rows.groupBy(F.col(lang).alias("y")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(MOST_LANGUAGES))
    spread = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < F.lit(float(PER_LANGUAGE << 30)) / F.col("n")
    # a language is a name, so that the table of sizes is small against the rows; Spark broadcasts it if it may
    sample = common.cut(rows.select(F.col(key).alias(key), F.col(text).alias("text"), F.col(lang).alias("y")).join(sizes, "y").where(spread).select("text", "y"))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            names, of = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            for order, h, row in counted(batch.column(0)):
                key, n = np.unique((of[row] * BUCKETS + h), return_counts=True)
                y, h = np.divmod(key, BUCKETS)
                yield pa.RecordBatch.from_arrays([pa.array(names[y], pa.string()), pa.array(np.full(len(h), order)), pa.array(h), pa.array(n)], ["y", "gram", "h", "n"])

    counts = common.cut(sample.mapInArrow(profiles, "y string, gram long, h long, n long").groupBy("y", "gram", "h").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("y", "gram").agg(F.sum("n").alias("total"))
    share = common.cut(counts.join(totals, ["y", "gram"]).withColumn("s", F.sqrt(F.col("n") / F.col("total"))))
    languages = sorted(r["y"] for r in share.select("y").distinct().collect())  # names that were sampled
    if not languages:
        return None
    apart = F.sum(F.col("s") * F.col("s")) - F.sum("s") * F.sum("s") / len(languages)  # how much languages differ in it
    kept = share.groupBy("gram", "h").agg(apart.alias("apart")).orderBy(F.round("apart", 12).desc(), "gram", "h").limit(MOST_FEATURES)
    table = share.join(F.broadcast(kept), ["gram", "h"]).select("y", "gram", "h", "s", "n").toPandas()  # MOST_FEATURES for each language
    grid = table[["gram", "h"]].drop_duplicates().sort_values(["gram", "h"], ignore_index=True)
    number = {o: np.zeros(BUCKETS, np.int64) for o in ORDERS}
    for i, (o, h) in enumerate(grid.itertuples(index=False, name=None)):
        number[o][h] = i + 1
    at = [number[o][h] - 1 for o, h in zip(table["gram"], table["h"], strict=True)]
    y = np.searchsorted(np.array(languages, object), table["y"].to_numpy(object))
    profile, n = np.zeros((len(languages), len(grid))), np.zeros((len(languages), len(grid)))
    profile[y, at], n[y, at] = table["s"], table["n"]
    names = families(languages, profile)
    known = sorted(set(names))
    family = np.array([known.index(x) for x in names])
    ones = np.array([n[family == c].sum(axis=0) for c in range(len(known))]) + 0.5
    log_share = np.log(ones / ones.sum(axis=1, keepdims=True)).T
    texts = {r["y"]: r["n"] for r in sizes.collect()}  # MOST_LANGUAGES rows
    prior = np.array([sum(texts[x] for x, c in zip(languages, family, strict=True) if c == k) for k in range(len(known))], float)
    pairs = [(a, b) for a in range(len(languages)) for b in range(a + 1, len(languages)) if family[a] == family[b]]
    model = Model(languages, family, number, log_share, np.log(prior / prior.sum()), pairs, np.zeros((len(pairs), len(grid) + 1)))
    if pairs:
        sent = spark.sparkContext.broadcast(model)
        meets = {x: [i for i, (a, b) in enumerate(pairs) if x in (languages[a], languages[b])] for x in languages}

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, "text"):
                m = sent.value
                r, f, _, v = m.features(batch.column(0))
                order = np.lexsort((f, r))
                r, f, v = r[order], f[order].astype(np.int32), v[order]
                cuts = np.searchsorted(r, np.arange(len(batch) + 1))
                names = batch.column(1).to_pylist()
                rows = [(p, int(m.languages[m.pairs[p][0]] == x), f[a:b].tobytes(), v[a:b].tobytes()) for x, a, b in zip(names, cuts[:-1], cuts[1:], strict=True) for p in meets[x]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["pair", "first", "f", "v"])

        def learned(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["first", "f", "v"], ignore_index=True)  # the same machine in any order of rows
            w = machine([np.frombuffer(x, np.int32) for x in rows["f"]], [np.frombuffer(x, np.float64) for x in rows["v"]], rows["first"].to_numpy() * 2.0 - 1, len(sent.value.log_share))
            return pd.DataFrame({"pair": [rows["pair"][0]], "w": [w.tobytes()]})

        for r in sample.mapInArrow(features, "pair long, first long, f binary, v binary").groupBy("pair").applyInPandas(learned, "pair long, w binary").collect():  # one row a pair
            model.weights[r["pair"]] = np.frombuffer(r["w"], np.float64)
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred (a learned language, `und` for null texts and those without a letter) and score (0 to 1; 0 for `und`).

    Whole texts are looked at, and nothing else of a row. Columns of these names are replaced. A text with letters but
    without known n-grams gets a language of the most frequent family, with a low score. If nothing was learned, all
    are `und`. Of equally likely languages the first by name is told.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: MOST_FEATURES for each family and pair

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            best, sure = sent.value.predict(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sent.value.languages[b] for b in best]), pa.array(sure)], [*batch.schema.names, "lang_pred", "score"])

    out = docs.mapInArrow(predicted, common.plus(docs, "lang_pred string, score double"))
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({"lang_pred": F.when(lettered, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(lettered, F.col("score")).otherwise(0.0)})


def held_out(key: str = "doc_id") -> Column:
    """Rows that learning leaves out: the checksum of the key as text is divisible by 5. Not true of a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
