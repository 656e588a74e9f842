"""One query for each numbered operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dart_minhash, decontamination, filter_audit, heap_clustering, language_id, licenses, permutation_index, secrets, sentencepiece, suffix_dedup, token_counts, toxicity
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontamination.items_digest().alias("items_sha256"), "contaminated")


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.neighbours(vectors, F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = secrets.listed(F.filter("secrets", lambda x: x["kind"] < 3))
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepiece.decode(sentencepiece.encode(docs, model), model)
    ids = F.array_join("pieces", ",").cast("binary")
    return rows.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("pieces_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("restored"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.repair(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", "action", F.array_join("inserted", ",").alias("inserted"), "rendered")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.col("n_bytes") - F.length("kept")
    return rows.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_heap_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_clustering.clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), language_id.held_out()
    model = language_id.fit(docs.select("doc_id", "text", "lang"), F.col("doc_id").isNotNull() & ~held_out)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_permutation_index, op3_toxicity, op4_secrets, op5_licenses, op6_sentencepiece, op7_chat, op8_suffix_dedup, op9_dart_minhash, op10_token_counts, op11_heap_clustering, op12_language_id, op13_filter_audit)}
_WORDS = r"[x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"



def _rounds_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """k-means in plain rounds: all distances, sums of all vectors. Integers of this size are exact as doubles."""
    near = "SELECT v.id, v.x, c.c, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.m) + list_inner_product(c.m, c.m) AS d FROM v CROSS JOIN c{0} c"
    best = "SELECT id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (" + near + ") y GROUP BY nth, id, x"
    best = best.replace("v.id,", "v.nth, v.id,")
    out = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS nth, vec_id AS id, [floor(256 * e::DOUBLE) for e in embedding] AS x FROM embeddings
WHERE len(embedding) = {size} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = {size})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT sha256('2:' || id) AS h, x FROM v WHERE id IS NOT NULL ORDER BY h, x LIMIT {k}) s)",
    ]
    for n in range(rounds):
        mean = "SELECT c, list(m ORDER BY i) AS m FROM (SELECT c, i, floor(sum(x[i]::BIGINT)::DOUBLE / count(*)) AS m FROM (SELECT c, x, unnest(range(1, %d)) AS i FROM a%d) u GROUP BY c, i) w GROUP BY c" % (size + 1, n)
        out.append(f"a{n} AS MATERIALIZED ({best.format(n)})")
        out.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.m, c.m) AS m FROM c{n} c LEFT JOIN ({mean}) n USING (c))")
    out.append(f"a{rounds} AS MATERIALIZED ({best.format(rounds)})")
    return f"""WITH {", ".join(out)} SELECT id AS vec_id, a.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string([y::BIGINT for y in c.m], ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (c)"""


_AUDIT = r"""WITH l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(source::VARCHAR, '') AS part, coalesce(text, '') AS t, [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] AS w FROM documents),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
 + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
 FROM d LEFT JOIN l USING (doc_id)),
n AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS t FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT o, s::INT AS s, bits[s] AS f, (list_sum(bits[1:s]) - bits[s])::INT AS p FROM (SELECT o, bits, unnest(range(1, 6)) AS s FROM o) u),
r AS (SELECT part, o, s, f, sum(n) FILTER (mask & (p | f) = 0) AS kept, sum(n) FILTER (mask & p = 0 AND mask & f > 0) AS removed, sum(n) FILTER (mask & p > 0 AND mask & f > 0) AS redundant,
 sum(n) FILTER (mask = f) AS unique_fails, sum(g) FILTER (mask & p = 0 AND mask & f > 0) AS good_lost, sum(t) FILTER (mask & p = 0 AND mask & f > 0) AS toxic_lost FROM n CROSS JOIN s GROUP BY ALL)
SELECT part, o AS filter_order, s AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
 coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM r"""

#: The others train, sample, encode or compare every byte position, which SQL can't express or is too slow at; they are
#: tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0) x),
dw AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM (SELECT d.doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) s WHERE len(w) >= n) x),
m AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM m) y GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM m) y GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op11_heap_clustering": _rounds_sql(),
    "op13_filter_audit": _AUDIT,
}
