"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import decontaminate, html_text, jaccard, media, mixing, sharding, surrogates, toxicity, url_filter, wavelet
from sparkweave.llm.common import table, text_crc32, text_size_bytes


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.tracking_hosts(pages))


OP1_SQL = """
WITH p AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
feed AS (
  SELECT host FROM p GROUP BY host
  HAVING sum(CASE WHEN contains(coalesce(url, ''), 'utm_source=') THEN 1 ELSE 0 END) >= greatest(0.25 * count(*), 1)),
judged AS (
  SELECT p.*, f.host IS NOT NULL AS listed,
         CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p LEFT JOIN feed f ON p.host = f.host)
SELECT page_id, host, path, rule, listed,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict
FROM judged
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.media_columns(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = wavelet.write_shards(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return wavelet.read_documents(files)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(toxicity.training_fold()))
    got = toxicity.score(docs, model)
    return got.select("doc_id", (~toxicity.training_fold()).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), "hits", "quoted")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's, or else drawn for this run, so that nobody can turn surrogates back by guessing."""
    return surrogates.replace(table(spark, sf_dir, "documents"), spark.conf.get("spark.sparkweave.pii.key", None) or secrets.token_hex(32))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", (text_size_bytes(F.col("text")) + 16).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    placed = sharding.assign_shards(narrow, "doc_id", shards=40)
    return placed.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


#: The shares in closed form, sources in order of cap by weight; then each source in hash order up to its budget.
OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(concat_ws('|', '29', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(md5(text), ''), coalesce(source, ''))) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS w, 2.0::DOUBLE * n AS most, 1.5::DOUBLE * sum(n) OVER () AS total FROM s),
o AS (
  SELECT *, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left, total - coalesce(sum(most) OVER before, 0) AS t_left
  FROM w WINDOW before AS (ORDER BY most / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * w_left <= w * t_left AS full_ FROM o),
t AS (
  SELECT source, n, CASE WHEN full_ THEN most ELSE w * (total - sum(CASE WHEN full_ THEN most ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (), 0) END AS target
  FROM f),
g AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, coalesce(CAST(floor(target) AS BIGINT) // nullif(n, 0), 0) AS epochs FROM t),
e AS (
  SELECT d.*, n, target, epochs, budget - epochs * n AS rest, sum(size) OVER equal_ AS words, count(*) OVER equal_ AS same, sum(size) OVER (PARTITION BY d.source ORDER BY place) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WINDOW equal_ AS (PARTITION BY d.source, place))
SELECT doc_id, size, n AS source_size, target,
       CAST(epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - words < rest THEN least(size, (rest - upto + words) // same) ELSE 0 END AS BIGINT) AS taken, source
FROM e
"""


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Word lists, shingle sets, all pairs that share a shingle, and the least id reachable, step by step.
OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS set
  FROM w),
n AS (SELECT doc_id, len(set) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(set) AS x FROM s),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n_shingles + q.n_shingles - shared)),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL
"""

def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_media_columns": op3_media_columns, "op6_token_shards": op6_token_shards, "op7_pii_surrogates": op7_pii_surrogates, "op4_toxicity": op4_toxicity, "op10_html_extraction": op10_html_extraction, "op1_url_filter": op1_url_filter, "op2_decontamination": op2_decontamination, "op9_ngram_jaccard": op9_ngram_jaccard, "op5_sharding": op5_sharding, "op8_mixing": op8_mixing}
ORACLES = {"op1_url_filter": OP1_SQL, "op8_mixing": OP8_SQL, "op9_ngram_jaccard": OP9_SQL}
