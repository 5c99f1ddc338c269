"""The operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import centroids, embeddings, html, matroska, minhash, mixing, negatives, packing, pii, quality, substrings, topk, toxicity
from tamis.llm.common import bounded_batches, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    light = materialize(docs.select("doc_id", "source", mixing.word_count(docs).alias("words")), "sizes")
    return mixing.fair_queue(light, size="words").select("doc_id", "size", "source_size", "target", "taken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=13)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.text_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1_024)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), dims=64, k=8, rounds=10, scale=1_024, seed="3")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


MIXING_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
own AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, (SELECT sum(source_size) * 1.5 FROM sums)::DOUBLE AS budget FROM sums),
fill(n, level) AS (
  SELECT 0, max(budget) / sum(w) FROM own
  UNION ALL
  SELECT n + 1, (SELECT (max(budget) - coalesce(sum(2 * source_size) FILTER (2 * source_size <= w * fill.level), 0)) / nullif(sum(w) FILTER (2 * source_size > w * fill.level), 0) FROM own)
  FROM fill WHERE n < (SELECT count(*) FROM own)),
lev AS (SELECT max(level) AS level FROM fill),
target AS (SELECT source, source_size, least(w * level, 2.0 * source_size)::DOUBLE AS target FROM own, lev),
queued AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(least(size, greatest(0, floor(target + 1e-6) - before)) + least(size, greatest(0, floor(target + 1e-6) - source_size - before)) AS BIGINT) AS taken FROM queued
"""

WORDS_SQL = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs of documents that share a shingle, and everything reachable over links.
MINHASH_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(_LOWERED)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 80 <= b.n * 100 AND b.n * 80 <= a.n * 100 GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS m FROM s UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.m)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(m) AS component_id, s.doc_id = min(m) AS kept FROM s JOIN reached ON reached.a = s.doc_id GROUP BY s.doc_id, s.s
"""

_WINDOW = "word" + "".join(f" || ' ' || lead(word, {k}) OVER d" for k in range(1, 13))
SUBSTRINGS_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
g AS (SELECT doc_id, pos, word, {_WINDOW} AS g FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT g, min(doc_id) AS first FROM g WHERE g IS NOT NULL GROUP BY g),
h AS (SELECT doc_id, pos, word, coalesce(first < doc_id, false)::INT AS hit FROM g LEFT JOIN f USING (g)),
c AS (SELECT doc_id, pos, word, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id) GROUP BY w.doc_id, w.w
"""

VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (SELECT vec_id AS a, vec_id AS m FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.m)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, min(m) AS component_id, vec_id = min(m) AS kept FROM v JOIN reached ON reached.a = vec_id GROUP BY vec_id
"""

_SOUND = "v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DOUBLES = "SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"

#: Every query against every row.
TOPK_SQL = f"""
WITH v AS (SELECT vec_id, rowid AS r, list_transform(v, lambda x: floor(1024 * x)) AS v FROM (SELECT *, row_number() OVER () AS rowid FROM ({_DOUBLES})) WHERE {_SOUND}),
pairs AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds of plain assignment and floored means, one after the other."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(v, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v FROM ({_DOUBLES}) WHERE len(v) = 64 AND {_SOUND})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS c, v FROM (SELECT v, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS MATERIALIZED (SELECT v.r, c, CAST(list_sum(list_transform(list_zip(v.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{n} k)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.v) AS x, unnest(range(64)) AS i FROM a{n} a JOIN v USING (r)) GROUP BY c, i) GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{n} k LEFT JOIN m{n} m USING (c))")
    last = f"SELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} k ON k.c = a.c"
    return "WITH " + ",\n".join(parts) + "\n" + last


#: All anchors against all rows, then every positive against every negative of its anchor.
NEGATIVES_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(v, lambda x: floor(256 * x)) AS v FROM ({_DOUBLES}) WHERE label IS NOT NULL AND {_SOUND}),
pairs AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positive AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 5),
numbered AS (SELECT *, row_number() OVER () AS p FROM positive),
mined AS (SELECT n.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.p ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank
  FROM numbered p JOIN pairs n ON n.r = p.r AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 3
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_substrings": op3_substrings,
    "op4_html": op4_html,
    "op5_pii": op5_pii,
    "op6_embeddings": op6_embeddings,
    "op7_matroska": op7_matroska,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_topk": op11_topk,
    "op12_clusters": op12_clusters,
    "op13_negatives": op13_negatives,
}
#: SQL says none of the others: tokenizers, parsers, trained models and files. tests/llm hold them against plain versions.
ORACLES = {
    "op2_minhash": MINHASH_SQL,
    "op3_substrings": SUBSTRINGS_SQL,
    "op6_embeddings": VECTORS_SQL,
    "op10_mixing": MIXING_SQL,
    "op11_topk": TOPK_SQL,
    "op12_clusters": _clusters_sql(),
    "op13_negatives": NEGATIVES_SQL,
}
