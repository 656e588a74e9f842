"""Operators 11 to 13: against plain k-means, held-out accuracy and a count of everything at once; odd inputs."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterglass.llm import dart_minhash, filter_audit, heap_clustering, language_id, permutation_index, queries

# ---- 11


def plain_rounds(rows, k, rounds, size):
    """(key, cluster, distance) by comparing all vectors with all centroids in every round."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    if not centroids:
        return [], []
    for n in range(rounds + 1):
        of = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
        if n < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, c, far(v, centroids[c])) for (i, v), c in zip(kept, of, strict=True)], centroids


@pytest.mark.parametrize("case", ["random", "grouped", "ties", "large", "few", "odd"])
def test_clusters_are_those_of_plain_rounds(spark, monkeypatch, case):
    monkeypatch.setattr(heap_clustering, "BLOCK", 50)
    rng = random.Random(11)
    size, k = 6, 7
    vector = {
        "random": lambda: [rng.uniform(-1, 1) for _ in range(size)],
        "grouped": lambda: [rng.choice((-3, 0, 3)) + rng.gauss(0, 0.05) for _ in range(size)],
        "ties": lambda: [float(rng.choice((0, 1))) for _ in range(size)],
        "large": lambda: [rng.uniform(-1, 1) * 2.0 ** rng.randint(0, 19) for _ in range(size)],
        "few": lambda: [rng.uniform(-1, 1) for _ in range(size)],
        "odd": lambda: rng.choice([None, [], [1.0] * 5, [1.0] * 7, [None] * 6, [float("nan")] * 6, [float("inf")] * 6, [rng.uniform(-1, 1) for _ in range(6)]]),
    }[case]
    rows = [(i, vector()) for i in range(4 if case == "few" else 300)]
    if case == "odd":
        rows += [(None, [0.5] * 6), (3, [0.25] * 6), (3, [0.25] * 6)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, x int").repartition(3)
    got = heap_clustering.clusters(table, k, 5, size).collect()
    want, centroids = plain_rounds(rows, k, 5, size)
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=order) == sorted(want, key=order)
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_only_expired_gaps_are_looked_at_again():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (5, 8))
    x = centroids[rng.integers(0, 5, 1000)] + rng.integers(-9, 9, (1000, 8))
    block = heap_clustering.Block(x, [[] for _ in range(5)])
    block.step(centroids, np.zeros(5), True)
    seen = []
    whole = heap_clustering.squares
    heap_clustering.squares = lambda a, c: seen.append(len(a)) or whole(a, c)
    try:
        assert block.step(centroids + 1, np.full(5, 2 * np.sqrt(8)), False) == [] and not seen
        block.step(centroids, np.full(5, 1e9), False)
        assert seen == [1000]
    finally:
        heap_clustering.squares = whole
    read = heap_clustering.Block.read(*block.written(), 8)
    assert read.heaps == block.heaps and (read.x == block.x).all()


def test_no_clusters_without_vectors_and_no_distances_beyond_long(spark):
    schema = "vec_id long, embedding array<float>"
    assert heap_clustering.clusters(spark.createDataFrame([], schema)).count() == 0
    assert heap_clustering.clusters(spark.createDataFrame([(None, [1.0] * 64)], schema)).count() == 0
    with pytest.raises(Exception, match="64-bit"):
        heap_clustering.clusters(spark.createDataFrame([(1, [1e30] * 64)], schema)).count()


# ---- 12

SYLLABLES = {"en": "the and ing tion ther of wh sh", "de": "der die sch ung ein ß ver lich", "fr": "le la eau ment é que ç oi", "es": "ción de los ñ ar ado que í", "xx": "zu ka mo ri ta ne", "yy": "zu ka mo ri ta no"}


def spoken(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_of_unseen_texts(spark):
    rng = random.Random(12)
    rows = [(i, spoken(rng, lang, rng.randint(5, 200)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [9, 3, 3, 3, 1, 1], k=900))]
    rows += [(1000 + i, t, lang) for i, (t, lang) in enumerate([(None, "en"), ("", "en"), ("12 !?", "fr"), ("日本語", None), (spoken(rng, "de", 30_000), None), ("the the", None)])] + [(None, "der die das", "de"), (1, rows[1][1], "en")]
    docs = spark.createDataFrame([(*r, 9.0, "x") for r in rows], "doc_id long, text string, lang string, score double, h string")
    model = language_id.fit(docs, F.col("doc_id").isNotNull() & ~language_id.held_out())
    assert model.languages == sorted(SYLLABLES)
    assert model.family[0] == model.family[1] and model.family[2] == model.family[3] != model.family[0]
    assert model.family[4] == model.family[5] and (4, 5) in model.pairs  # not known, but alike
    got = language_id.predict(docs, model).withColumn("held", language_id.held_out()).collect()
    assert len(got) == len(rows) and {(r.h) for r in got} == {"x"}
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000].score == 0
    assert by_id[1003].lang_pred in SYLLABLES and by_id[1004].lang_pred == "de" and by_id[1005].lang_pred == "en" and by_id[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)
    again = language_id.predict(docs.repartition(5), language_id.fit(docs.repartition(7), F.col("doc_id").isNotNull() & ~language_id.held_out())).collect()
    assert sorted((str(r.doc_id), str(r.text), r.lang_pred) for r in again) == sorted((str(r.doc_id), str(r.text), r.lang_pred) for r in got)


def test_nothing_learned_is_no_language(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert language_id.fit(docs, F.lit(True)) is None and language_id.fit(docs.limit(0), F.lit(True)) is None
    assert [tuple(r) for r in language_id.predict(docs, None).collect()] == [(1, "words", None, "und", 0.0)]


def test_one_language_and_one_family(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["the man", "a word", "an other"])], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs, F.lit(True))).collect()} == {"en"}


def test_languages_of_the_table(spark, sf_dir):
    rows = queries.op12_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


# ---- 13


def counted(rows, labels):
    """The audit by applying each order to each document."""
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    fails, parts = [], {}
    for n, (i, t, part) in enumerate(rows):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        caps = sum("A" <= c <= "Z" for c in t)
        copy = i is not None and min(ids[t]) < i
        fails.append({f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * caps > 2 * len(t), re.search(r"[#$%&*|]", t), copy), strict=True) if x})
        parts.setdefault(part or "", []).append(n)
    out, shapley = {}, {}
    for part, of in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = list(of)
            for step, f in enumerate(order):
                gone = [n for n in left if f in fails[n]]
                left = [n for n in left if f not in fails[n]]
                label = lambda j: sum(labels.get(rows[n][0], (0, 0))[j] == 1 for n in gone)  # noqa: B023, E731
                failing = sum(f in fails[n] for n in of)
                out[part, "".join(order), step + 1] = (len(left), len(gone), failing - len(gone), sum(fails[n] == {f} for n in of), label(0), label(1))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order_of_files_gives_the_counts_of_one_pass(spark, tmp_path):
    rng = random.Random(13)
    long = " ".join(f"w{rng.randint(0, 900)}" for _ in range(20_000))
    texts = [None, "", " ", "A B C", "x" * 50, "a # b", long, long + "|", " ".join(["again"] * 300), " ".join(f"v{i}" for i in range(250)), "\x0b\x0c é é 🙂 " * 120, "\u0000 A"]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "a", "a", "a", "b"])) for i in range(400)]
    rows += [(7, rows[7][1], rows[7][2]), (7, rows[7][1], "b"), (None, "A B C", "a"), (None, None, "c"), (-3, "A B C", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)]
    known = {i: (q, t) for i, q, t in labels}
    rng.shuffle(rows)
    for n in range(6):
        part = rows[n::6]
        spark.createDataFrame([(i, t, p, 1, 2) for i, t, p in part], "doc_id long, text string, source string, mask int, h int").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    table = spark.createDataFrame([*labels, (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")
    for rounds in ({}, {"least_bytes": 1, "most_rounds": 100}):  # one micro-batch, and one for each file
        got = filter_audit.interactions(spark, str(tmp_path / "docs"), table, **rounds).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == counted(rows, known) and len(got) == 600 * len({p or "" for *_, p in rows})


def test_a_stopped_audit_goes_on(spark, tmp_path):
    docs, folder = str(tmp_path / "docs"), str(tmp_path / "work")
    schema = "doc_id long, text string, source string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    spark.createDataFrame([(5, "same", "a"), (6, "same", "a")], schema).coalesce(1).write.parquet(docs)
    first = filter_audit.masks(filter_audit.documents(spark, docs), labels, folder).collect()
    assert sorted((r["mask"], r["n"]) for r in first if r["n"]) == [(1, 1), (17, 1)]
    spark.createDataFrame([(2, "same", "b")], schema).coalesce(1).write.mode("append").parquet(docs)
    again = filter_audit.masks(filter_audit.documents(spark, docs), labels, folder).collect()
    assert sorted((r["part"], r["mask"], r["n"]) for r in again if r["n"]) == [("a", 17, 2), ("b", 1, 1)]


def test_an_empty_table_has_no_parts(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(spark, str(tmp_path / "docs"), labels).count() == 0


# ---- 9 and 2 on odd rows


def test_a_key_with_several_texts_is_alike_to_all_that_these_are(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randint(0, 10_000)}" for _ in range(n)]
    a, b, c = prose(80), prose(80), prose(80)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, " ".join(c)), (5, ""), (6, None), (6, " ".join(b)), (7, "!"), (7, "?"), (8, "?"), (9, "lone")]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 1, 7: 7, 8: 7, 9: 9}
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: str(r[1]))):
        got = dart_minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert {(r.doc_id, r.class_id) for r in got} == set(want.items()) and len(got) == len(rows)


def test_neighbours_of_vectors_of_any_size(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 8))
    size = 10.0 ** rng.choice([-300, -200, 0, 200, 300], 150)
    table = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v * size[:, None])], "vec_id long, embedding array<double>")
    got = permutation_index.neighbours(table, F.col("vec_id") % 50 == 0).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = 0
    for q in (0, 50, 100):
        near = unit @ unit[q]
        near[q] = -2
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - near[r.vec_id]) < 1e-9 for r in mine)
        found += len({r.vec_id for r in mine} & set(np.argsort(-near)[:5].tolist()))
    assert found >= 14


# ---- SQL


@pytest.mark.parametrize("name", ["op11_heap_clustering", "op13_filter_audit"])
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    assert len(got) and sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
