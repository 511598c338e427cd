"""The registered queries over the driver's tables, each with the SQL that must give the same rows.

The tables stand for the service's: embeddings for the items (file_id, species, source, paths, index ids) and their
vectors, events for the feedback on search results, part for the assets to validate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.functions import vectors as V
from sparkweave.operators import explain, feedback, knn, maintenance, quality, ranking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The adapters, in SQL that both engines read.
ITEM = {
    "file_id": "vec_id", "species": "'species ' || CAST(label AS STRING)", "source": "CASE WHEN vec_id % 3 = 0 THEN 'field' ELSE 'lab' END",
    "image_path": "'img/' || CAST(vec_id AS STRING) || '.jpg'", "segmented_path": "CASE WHEN vec_id % 4 = 0 THEN NULL ELSE 'seg/' || CAST(vec_id AS STRING) || '.png' END",
    "faiss_id": "CASE WHEN vec_id % 5 = 0 THEN NULL ELSE vec_id END", "milvus_id": "CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id END",
}
FEEDBACK = {
    "id": "event_id", "query_hash": "md5(CAST(user_id % 40 AS STRING))", "file_id": "event_id % 397", "position": "event_id % 12 + 1",
    "feedback_type": "CASE (event_id * 7 + user_id) % 5 WHEN 0 THEN 'relevant' WHEN 1 THEN 'irrelevant' WHEN 2 THEN 'clicked' WHEN 3 THEN 'selected' ELSE 'dismissed' END",
    "created_at": "ts",
}
ASSET = {"file_id": "p_partkey", "species": "CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 13 = 0 THEN 'ab' ELSE p_name END", "size": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_retailprice * 10 AS BIGINT) END", "width": "p_size * 20", "height": "p_partkey % 900", "intensity": "CAST(p_partkey % 256 AS DOUBLE)"}
select = lambda cols, of: "SELECT " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM {of}"
WITH = f"WITH items AS ({select(ITEM, 'embeddings')}), feedback AS ({select(FEEDBACK, 'events')}), assets AS ({select(ASSET, 'part')}), vec AS (SELECT vec_id AS file_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _adapter(table: str, cols: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{table}.parquet").selectExpr(*[f"{e} AS {n}" for n, e in cols.items()])


items, events, assets = _adapter("embeddings", ITEM), _adapter("events", FEEDBACK), _adapter("part", ASSET)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("file_id"), F.col("embedding").alias("v"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The query set: every 20th vector."""
    return corpus(spark, d).filter("file_id % 20 = 0").withColumnRenamed("file_id", "query_id")


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"{WITH}, " if sql.lstrip().startswith("x ") or " AS (" in sql.split("SELECT")[0] else f"{WITH} ") + sql
        return f

    return put


# --- nearest neighbours and vector functions ---------------------------------------------------------------------

_NORM = "(sqrt(list_inner_product({0}, {0})) + 1e-8)"
_COS = f"list_inner_product(q.v, c.v) / ({_NORM.format('q.v')} * {_NORM.format('c.v')})"
_SQL_METRIC = {
    "cosine": (_COS, "DESC"), "inner_product": ("list_inner_product(q.v, c.v)", "DESC"), "l2": ("list_distance(q.v, c.v)", "ASC"),
    "l1": ("list_sum(list_transform(list_zip(q.v, c.v), lambda p: abs(p[1] - p[2])))", "ASC"), "angular": (f"acos(greatest(-1.0, least(1.0, {_COS})))", "ASC"),
}


def _knn_sql(metric: str, k: int) -> str:
    e, way = _SQL_METRIC[metric]
    return f"""x AS (SELECT q.file_id AS query_id, c.file_id, round({e}, 6) AS score FROM vec q, vec c WHERE q.file_id % 20 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {way}, file_id) AS rank FROM x)
      SELECT query_id, rank, file_id, score FROM r WHERE rank <= {k}"""


for _m in V.METRICS:
    query(f"knn_{_m}", _knn_sql(_m, 10))(lambda spark, d, m=_m: knn.search(corpus(spark, d), asked(spark, d), m, 10))


@query("knn_over_retrieval", _knn_sql("cosine", 50))
def _(spark, d):
    return knn.search(corpus(spark, d), asked(spark, d), "cosine", min(5 * 10, 1000))


@query("ivf_knn")
def _(spark, d):
    indexed, centres = knn.build_cells(corpus(spark, d))
    return knn.search_cells(indexed, centres, asked(spark, d))


@query("vector_distances", "SELECT q.file_id AS a, c.file_id AS b, " + ", ".join(f"round({e}, 6) AS {m}" for m, (e, _) in _SQL_METRIC.items()) + f", round(1 - {_COS}, 6) AS cosine_distance, round(exp(-list_distance(q.v, c.v)), 6) AS similarity, round(1 / (1 + list_distance(q.v, c.v)), 6) AS inverse_similarity FROM vec q JOIN vec c ON c.file_id = q.file_id + 1")
def _(spark, d):
    a = corpus(spark, d).select(F.col("file_id").alias("a"), F.col("v").alias("x"))
    b = corpus(spark, d).select(F.col("file_id").alias("b"), F.col("v").alias("y"))
    x, y = F.col("x"), F.col("y")
    cols = [F.round(V.score(m, x, y), 6).alias(m) for m in V.METRICS]
    far = V.l2(x, y)
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", *cols, F.round(1 - V.cosine(x, y), 6).alias("cosine_distance"), F.round(V.similarity(far), 6).alias("similarity"), F.round(V.inverse_similarity(far), 6).alias("inverse_similarity"))


@query("vector_stats", "SELECT file_id, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS deviation, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS most, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM vec")
def _(spark, d):
    v = F.col("v")
    return corpus(spark, d).select("file_id", F.round(V.mean(v), 6).alias("mean"), F.round(V.deviation(v), 6).alias("deviation"), F.round(F.array_max(F.transform(V.dbl(v), F.abs)), 6).alias("most"), F.round(V.norm(v), 6).alias("norm"))


@query("normalize_l2", f"x AS (SELECT file_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS e, {_NORM.format('v')} AS n FROM vec) SELECT file_id, i, round(e / n, 6) AS x FROM x")
def _(spark, d):
    return corpus(spark, d).select("file_id", F.posexplode(V.normalised_for("l2", F.col("v"))).alias("i", "e")).select("file_id", F.col("i").cast("long").alias("i"), F.round("e", 6).alias("x"))


@query("normalize_zscore", "x AS (SELECT file_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS e, list_avg(v) AS m, list_stddev_pop(v) AS s FROM vec) SELECT file_id, i, round((e - m) / (s + 1e-8), 5) AS x FROM x")
def _(spark, d):
    return corpus(spark, d).select("file_id", F.posexplode(V.zscore(F.col("v"))).alias("i", "e")).select("file_id", F.col("i").cast("long").alias("i"), F.round("e", 5).alias("x"))


def _cut(v: str, i: int) -> str:
    return f"{v}[{'len(' + v + ') // 4 * ' + str(i)} + 1:{'len(' + v + ')' if i == 3 else 'len(' + v + ') // 4 * ' + str(i + 1)}]"


@query("region_similarity", "SELECT q.file_id AS a, c.file_id AS b, " + ", ".join(f"round(list_inner_product({_cut('q.v', i)}, {_cut('c.v', i)}) / ({_NORM.format(_cut('q.v', i))} * {_NORM.format(_cut('c.v', i))}), 6) AS region_{i}" for i in range(4)) + " FROM vec q JOIN vec c ON c.file_id = q.file_id + 1")
def _(spark, d):
    a = corpus(spark, d).select(F.col("file_id").alias("a"), F.col("v").alias("x"))
    b = corpus(spark, d).select(F.col("file_id").alias("b"), F.col("v").alias("y"))
    parts = [F.round(r, 6).alias(f"region_{i}") for i, r in enumerate(V.regions(F.col("x"), F.col("y")))]
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", *parts)


@query("centroids", "x AS (SELECT species, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS e FROM vec JOIN items USING (file_id)) SELECT species, i, round(avg(e), 6) AS x FROM x GROUP BY ALL")
def _(spark, d):
    each = corpus(spark, d).join(items(spark, d).select("file_id", "species"), "file_id").select("species", F.posexplode(V.dbl(F.col("v"))).alias("i", "e"))
    return each.groupBy("species", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("e"), 6).alias("x"))


# --- catalogue lookups, filters, aggregates -----------------------------------------------------------------------


@query("item_lookup", "SELECT * FROM items WHERE file_id = 7")
def _(spark, d):
    return items(spark, d).filter("file_id = 7")


@query("items_by_ids", "SELECT file_id, species, source FROM items WHERE file_id IN (3, 5, 8, 13, 100000)")
def _(spark, d):
    return items(spark, d).filter(F.col("file_id").isin(3, 5, 8, 13, 100000)).select("file_id", "species", "source")


@query("species_items", "SELECT file_id, species, coalesce(segmented_path, image_path) AS path FROM items WHERE species = 'species 1' ORDER BY file_id LIMIT 10")
def _(spark, d):
    found = items(spark, d).filter("species = 'species 1'").orderBy("file_id").limit(10)
    return found.select("file_id", "species", F.coalesce("segmented_path", "image_path").alias("path"))


@query("species_list", "SELECT DISTINCT species FROM items")
def _(spark, d):
    return items(spark, d).select("species").distinct()


@query("catalog_stats", "SELECT count(*) AS total, count(DISTINCT species) AS species, count(*) FILTER (source = 'lab') AS lab, count(*) FILTER (source = 'field') AS field FROM items")
def _(spark, d):
    return items(spark, d).agg(F.count("*").alias("total"), F.count_distinct("species").alias("species"), F.count_if(F.col("source") == "lab").alias("lab"), F.count_if(F.col("source") == "field").alias("field"))


@query("top_species", "SELECT species, count(*) AS total, count(*) FILTER (source = 'lab') AS lab, count(*) FILTER (source = 'field') AS field FROM items GROUP BY species ORDER BY total DESC, species LIMIT 10")
def _(spark, d):
    by = items(spark, d).groupBy("species").agg(F.count("*").alias("total"), F.count_if(F.col("source") == "lab").alias("lab"), F.count_if(F.col("source") == "field").alias("field"))
    return by.orderBy(F.desc("total"), "species").limit(10)


@query("index_coverage", "SELECT count(*) FILTER (faiss_id IS NULL AND milvus_id IS NULL) AS neither, count(*) FILTER (faiss_id IS NOT NULL AND milvus_id IS NOT NULL) AS both_, count(*) FILTER (faiss_id IS NOT NULL OR milvus_id IS NOT NULL) AS either FROM items")
def _(spark, d):
    a, b = F.col("faiss_id").isNull(), F.col("milvus_id").isNull()
    return items(spark, d).agg(F.count_if(a & b).alias("neither"), F.count_if(~a & ~b).alias("both_"), F.count_if(~a | ~b).alias("either"))


@query("unindexed_items", "SELECT file_id FROM items WHERE faiss_id IS NULL")
def _(spark, d):
    all_ = items(spark, d)
    return all_.select("file_id").join(all_.filter("faiss_id IS NOT NULL").select("file_id"), "file_id", "left_anti")


@query("sync_report", "SELECT CASE WHEN i.faiss_id IS NULL THEN 'missing' ELSE 'indexed' END AS status, count(*) AS n FROM items i GROUP BY 1")
def _(spark, d):
    all_ = items(spark, d)
    return maintenance.sync_report(all_, all_.filter("faiss_id IS NOT NULL"), "file_id")


@query("hits_join_metadata", _knn_sql("cosine", 5).replace("SELECT query_id, rank, file_id, score FROM r WHERE", "SELECT query_id, rank, r.file_id, species, source, score FROM r JOIN items i ON i.file_id = r.file_id WHERE"))
def _(spark, d):
    hits = knn.search(corpus(spark, d), asked(spark, d), "cosine", 5)
    return hits.join(items(spark, d), "file_id").select("query_id", "rank", "file_id", "species", "source", "score")


@query("next_surrogate_key", "SELECT max(file_id) + 1 AS next FROM items")
def _(spark, d):
    return items(spark, d).agg((F.max("file_id") + 1).alias("next"))


@query("species_slugs", "SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(species)), ' ', '_', 'g'), '[^\\p{L}\\p{N}_-]', '', 'g') AS slug FROM items")
def _(spark, d):
    return items(spark, d).select(maintenance.slug(F.col("species")).alias("slug")).distinct()


@query("stratified_split", "x AS (SELECT file_id, species, row_number() OVER (PARTITION BY species ORDER BY md5(CAST(file_id AS STRING) || '|42'), file_id) AS spot, count(*) OVER (PARTITION BY species) AS n FROM items) SELECT file_id, species, CASE WHEN spot <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN spot <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM x")
def _(spark, d):
    return maintenance.stratified_split(items(spark, d), "file_id", "species")


@query("augmentation_plan", "SELECT species, count(*) AS original, greatest(60 - count(*), 0) AS added FROM items GROUP BY species")
def _(spark, d):
    return maintenance.augmentation_plan(items(spark, d), "species", 60)


@query("upsert", "SELECT file_id, CASE WHEN file_id % 10 = 0 THEN 'changed' ELSE species END AS species FROM items")
def _(spark, d):
    old = items(spark, d).select("file_id", "species")
    return maintenance.upsert(old, old.filter("file_id % 10 = 0").withColumn("species", F.lit("changed")), "file_id")


@query("delete_cascade", "SELECT f.id, f.file_id FROM feedback f WHERE f.file_id IN (SELECT file_id FROM items WHERE file_id % 3 <> 0)")
def _(spark, d):
    kept = items(spark, d).filter("file_id % 3 <> 0")
    return maintenance.delete_cascade(events(spark, d), kept, "file_id", "file_id").select("id", "file_id")


# --- feedback ---------------------------------------------------------------------------------------------------------

_RATE = "round(avg(CASE WHEN feedback_type IN ({}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)"


@query("feedback_stats", f"SELECT file_id, count(*) AS events, {_RATE.format(chr(39) + 'clicked' + chr(39) + ',' + chr(39) + 'selected' + chr(39))} AS ctr, {_RATE.format(chr(39) + 'selected' + chr(39))} AS conversion, round(coalesce(avg(position), 0), 6) AS avg_position FROM feedback GROUP BY file_id")
def _(spark, d):
    return feedback.file_stats(events(spark, d))


@query("judgments", "SELECT query_hash, file_id, CASE WHEN feedback_type IN ('relevant', 'selected') THEN 'relevant' ELSE 'irrelevant' END AS judged FROM feedback WHERE feedback_type <> 'clicked'")
def _(spark, d):
    return feedback.judgments(events(spark, d))


@query("graded_relevance", "x AS (SELECT query_hash, file_id, sum(CASE feedback_type WHEN 'relevant' THEN 2.0::DOUBLE WHEN 'selected' THEN 1.5::DOUBLE WHEN 'clicked' THEN 0.5::DOUBLE WHEN 'irrelevant' THEN -1.0::DOUBLE ELSE -0.5::DOUBLE END) AS relevance, min(position) AS p FROM feedback GROUP BY ALL) SELECT query_hash, file_id, relevance, row_number() OVER (PARTITION BY query_hash ORDER BY p, file_id) AS place FROM x")
def _(spark, d):
    return feedback.graded_relevance(events(spark, d))


_ROCCHIO = """j AS (SELECT (user_id % 40) * 20 AS query_id, event_id % 397 AS file_id, CASE WHEN (event_id * 7 + user_id) % 5 IN (0, 3) THEN 'relevant' ELSE 'irrelevant' END AS judged FROM events WHERE (event_id * 7 + user_id) % 5 <> 2),
  p AS (SELECT query_id, judged, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS e FROM j JOIN vec USING (file_id)),
  m AS (SELECT query_id, i, avg(e) FILTER (judged = 'relevant') AS good, avg(e) FILTER (judged = 'irrelevant') AS bad FROM p GROUP BY ALL),
  o AS (SELECT file_id AS query_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS e FROM vec WHERE file_id % 20 = 0),
  y AS (SELECT o.query_id, o.i, o.e, s.query_id IS NOT NULL AS seen, o.e + 0.75::DOUBLE * coalesce(good, 0) - 0.15::DOUBLE * coalesce(bad, 0) AS y FROM o LEFT JOIN m ON m.query_id = o.query_id AND m.i = o.i LEFT JOIN (SELECT DISTINCT query_id FROM m) s ON s.query_id = o.query_id),
  n AS (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY query_id)) AS n FROM y)
  SELECT query_id, i, round(CASE WHEN seen AND n > 0 THEN y / n ELSE e END, 6) AS x FROM n"""


@query("rocchio_refine", _ROCCHIO)
def _(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").selectExpr("(user_id % 40) * 20 AS query_hash", f"{FEEDBACK['file_id']} AS file_id", f"{FEEDBACK['feedback_type']} AS feedback_type")
    judged = feedback.judgments(raw).withColumnRenamed("query_hash", "query_id")
    return feedback.refine(asked(spark, d), judged, corpus(spark, d))


# --- ranking ----------------------------------------------------------------------------------------------------------

_HITS = _knn_sql("l2", 50).split("SELECT query_id, rank, file_id, score FROM r")[0] + ", h AS (SELECT query_id, rank, r.file_id, score, species, source, n FROM r JOIN items USING (file_id) JOIN (SELECT species, count(*) AS n FROM items GROUP BY species) USING (species) WHERE rank <= 50)"


def hits(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """(query_id, rank, file_id, score, species, source, n): l2 candidates with metadata and their species' size."""
    found = knn.search(corpus(spark, d), asked(spark, d), "l2", k)
    all_ = items(spark, d)
    counts = all_.groupBy("species").agg(F.count("*").alias("n"))
    return found.join(all_.select("file_id", "species", "source"), "file_id").join(counts, "species")


@query("minmax_scores", f"{_HITS} SELECT query_id, file_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END, 6) AS x FROM h WINDOW w AS (PARTITION BY query_id)")
def _(spark, d):
    return hits(spark, d).select("query_id", "file_id", F.round(ranking.min_max(F.col("score"), 1.0), 6).alias("x"))


_SOFT = f"""{_HITS}, q AS (SELECT query_id, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr, min(score) AS lo FROM h GROUP BY query_id),
  e AS (SELECT h.*, exp(-(score - lo) / greatest(greatest(iqr, 1e-6) * 0.25::DOUBLE, 1e-6)) AS e FROM h JOIN q USING (query_id)),
  s AS (SELECT *, e / (sum(e) OVER (PARTITION BY query_id) + 1e-9) AS soft FROM e)"""


@query("softmax_similarity", f"{_SOFT} SELECT query_id, file_id, round(soft, 6) AS x FROM s")
def _(spark, d):
    return hits(spark, d).select("query_id", "file_id", F.round(ranking.tempered_softmax(F.col("score")), 6).alias("x"))


_IDF = f"""{_SOFT}, i AS (SELECT *, ln(1 + max(n) OVER (PARTITION BY query_id)::DOUBLE / n) AS idf FROM s),
  p AS (SELECT *, pow(CASE WHEN max(idf) OVER w > min(idf) OVER w THEN (idf - min(idf) OVER w) / (max(idf) OVER w - min(idf) OVER w) ELSE 0.5 END, 0.3) AS prior FROM i WINDOW w AS (PARTITION BY query_id)),
  t AS (SELECT query_id, CASE WHEN count(*) FILTER (source = 'lab') * 2 > count(*) THEN 'lab' ELSE 'field' END AS preferred FROM h WHERE rank <= 5 GROUP BY query_id)"""


@query("species_idf", f"{_IDF} SELECT query_id, file_id, round(prior, 6) AS x FROM p")
def _(spark, d):
    return hits(spark, d).select("query_id", "file_id", F.round(ranking.idf_prior(F.col("n")), 6).alias("x"))


@query("source_vote", f"{_IDF} SELECT * FROM t")
def _(spark, d):
    return ranking.source_vote(hits(spark, d))


def blended(spark: SparkSession, d: str) -> DataFrame:
    found = hits(spark, d)
    x = found.join(ranking.source_vote(found), "query_id")
    soft, prior = ranking.tempered_softmax(F.col("score")), ranking.idf_prior(F.col("n"))
    return x.withColumn("final", F.round(ranking.blend(soft, prior, ranking.source_score(F.col("source"), F.col("preferred")), F.lit(1.0)), 6))


_BLEND = f"{_IDF}, b AS (SELECT p.*, round((0.70::DOUBLE * soft + 0.05::DOUBLE * prior + 0.15::DOUBLE * CASE WHEN source = preferred THEN 1.0 ELSE 0.7 END) / (0.70::DOUBLE + 0.05::DOUBLE + 0.15::DOUBLE), 6) AS final FROM p JOIN t USING (query_id)), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, file_id) AS place FROM b)"


@query("two_stage_search", f"{_BLEND} SELECT query_id, place, file_id, species, source, final FROM f WHERE place <= 10")
def _(spark, d):
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "file_id")).cast("long")
    return blended(spark, d).withColumn("place", place).filter("place <= 10").select("query_id", "place", "file_id", "species", "source", "final")


@query("query_kinds", "SELECT file_id AS query_id, CASE WHEN round(list_stddev_pop(v), 9) > 0.15 AND list_max(v) > 2 THEN 'specific' WHEN round(list_stddev_pop(v), 9) < 0.08 THEN 'general' ELSE 'ambiguous' END AS kind FROM vec WHERE file_id % 20 = 0")
def _(spark, d):
    v = F.col("v")
    return asked(spark, d).select("query_id", ranking.query_kind(F.round(V.deviation(v), 9), F.array_max(V.dbl(v))).alias("kind"))


def relevant(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, file_id, relevance, v, species, source): 50 candidates by cosine."""
    found = knn.search(corpus(spark, d), asked(spark, d), "cosine", 50).withColumnRenamed("score", "relevance")
    return found.join(corpus(spark, d), "file_id").join(items(spark, d).select("file_id", "species", "source"), "file_id")


def _greedy(relevance: str, value: str, first: str = "n = 0") -> str:
    """Picks one by one: value of a candidate, from the candidate (c) and what was picked (near, same, other)."""
    head = _knn_sql("cosine", 50).split("SELECT query_id, rank, file_id, score FROM r")[0]
    return f"""{WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, {head}, k AS (SELECT r.query_id, r.file_id, r.score, list_distance(q.v, c.v) AS d, c.v, species, source FROM r JOIN vec q ON q.file_id = r.query_id JOIN vec c ON c.file_id = r.file_id JOIN items i ON i.file_id = r.file_id WHERE rank <= 50),
  k1 AS (SELECT *, {relevance} AS rel FROM k), c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, file_id) AS place FROM k1),
  s AS MATERIALIZED (SELECT q.query_id, q.file_id AS a, c.file_id AS b, {_COS} AS sim, q.species = c.species AS alike, q.source <> c.source AS apart FROM c q JOIN c ON c.query_id = q.query_id),
  m(query_id, n, file_id, rel, picks) AS (SELECT query_id, CAST(1 AS BIGINT), file_id, rel, [file_id] FROM c WHERE place = 1 UNION ALL
    SELECT query_id, n + 1, file_id, rel, list_append(picks, file_id) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN {first} THEN 0 ELSE round({value}, 6) END DESC, place) AS t FROM
      (SELECT m.query_id, m.n, m.picks, c.file_id, c.rel, c.place, max(sim) AS near, count(*) FILTER (alike) AS same, bool_and(apart) AS other FROM m JOIN c ON c.query_id = m.query_id JOIN s ON s.query_id = m.query_id AND s.a = c.file_id
       WHERE m.n < 10 AND NOT list_contains(m.picks, c.file_id) AND list_contains(m.picks, s.b) GROUP BY ALL)) WHERE t = 1)"""


_BOTH = "round(0.5::DOUBLE * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END + 0.5::DOUBLE * CASE WHEN max(exp(-d)) OVER w > min(exp(-d)) OVER w THEN (exp(-d) - min(exp(-d)) OVER w) / (max(exp(-d)) OVER w - min(exp(-d)) OVER w) ELSE 1 END, 6)"


@query("mmr_classic")
def _(spark, d):
    """Relevance is half the cosine and half the similarity score, each min-max in its list."""
    q = asked(spark, d).withColumnRenamed("v", "q")
    near = F.exp(-V.l2(F.col("q"), F.col("v")))
    both = 0.5 * ranking.min_max(F.col("relevance"), 1.0) + 0.5 * ranking.min_max(F.col("near"), 1.0)
    x = relevant(spark, d).join(q, "query_id").withColumn("near", near).withColumn("relevance", F.round(both, 6))
    return ranking.mmr(x, 10)


@query("mmr_free_head")
def _(spark, d):
    return ranking.mmr(relevant(spark, d), 10, free=3)


@query("feature_diversity")
def _(spark, d):
    return ranking.feature_diversity(relevant(spark, d), 10)


ORACLES["mmr_classic"] = _greedy(_BOTH + " ", "0.7::DOUBLE * rel - 0.3::DOUBLE * near").replace("AS rel FROM k)", "AS rel FROM k WINDOW w AS (PARTITION BY query_id))") + " SELECT query_id, n AS position, file_id, rel AS relevance FROM m"
ORACLES["mmr_free_head"] = _greedy("score", "0.7::DOUBLE * rel - 0.3::DOUBLE * near", "n < 3") + " SELECT query_id, n AS position, file_id, rel AS relevance FROM m"
ORACLES["feature_diversity"] = _greedy("score", "0.7::DOUBLE * rel + 0.3::DOUBLE * (0.4::DOUBLE * pow(0.5::DOUBLE, same) + 0.2::DOUBLE * CASE WHEN other THEN 1.0 ELSE 0.5 END + 0.4::DOUBLE * (1 - near))") + " SELECT query_id, n AS position, file_id FROM m"


@query("cluster_diversity", _knn_sql("cosine", 50).split("SELECT query_id, rank, file_id, score FROM r")[0] + ", c AS (SELECT r.*, label AS cluster, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, r.file_id) AS turn FROM r JOIN embeddings ON vec_id = r.file_id WHERE rank <= 50), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn > 1, score DESC, file_id) AS position FROM c) SELECT query_id, position, file_id, cluster FROM o WHERE position <= 10")
def _(spark, d):
    label = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("file_id"), F.col("label").alias("cluster"))
    found = knn.search(corpus(spark, d), asked(spark, d), "cosine", 50).withColumnRenamed("score", "relevance")
    return ranking.best_of_clusters(found.join(label, "file_id"), 10)


def learned(spark: SparkSession, d: str) -> DataFrame:
    """Features of the l2 candidates, with the rates and the graded label of the item's feedback; 0 where there is none."""
    total = items(spark, d).count()
    found = hits(spark, d)
    near = F.exp(-F.col("score"))
    x = found.withColumns({"vector_similarity": near, "cosine_similarity": 1 - F.col("score") * F.col("score") / 2, "l2_distance": F.col("score"), "species_frequency": F.col("n") / total, "species_popularity": F.col("n") / total, "source_score": F.when(F.col("source") == "lab", 1.0).otherwise(0.5)})
    x = x.withColumns({k: F.lit(v) for k, v in ranking.DEFAULTS.items()})
    e = events(spark, d)
    known = feedback.file_stats(e).select("file_id", "ctr", "conversion").join(feedback.labels(e), "file_id")
    x = x.join(known, "file_id", "left").withColumns({"click_through_rate": F.coalesce("ctr", "click_through_rate"), "conversion_rate": F.coalesce("conversion", "conversion_rate")})
    return x.withColumn("label", F.coalesce("label", F.lit(0.0)))


#: An item's rates and label, from its feedback.
_LABELS = "fl AS (SELECT file_id, " + ", ".join(f"round(avg(CASE WHEN feedback_type IN ({k}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS {n}" for n, k in (("ctr", "'clicked', 'selected'"), ("conversion", "'selected'"))) + ", greatest(0, avg(CASE feedback_type WHEN 'relevant' THEN 2.0::DOUBLE WHEN 'selected' THEN 1.5::DOUBLE WHEN 'clicked' THEN 0.5::DOUBLE WHEN 'irrelevant' THEN -1.0::DOUBLE ELSE -0.5::DOUBLE END) + 1) AS label FROM feedback GROUP BY file_id)"
_LTR = f"{_HITS}, g AS (SELECT *, (SELECT count(*) FROM items) AS total FROM h), {_LABELS}, l AS (SELECT query_id, file_id, coalesce(label, 0) AS label, round(0.30::DOUBLE * exp(-score) + 0.20::DOUBLE * (1 - score * score / 2) - 0.10::DOUBLE * score + 0.15::DOUBLE * n / total + 0.10::DOUBLE * 0.8 + 0.05::DOUBLE * CASE WHEN source = 'lab' THEN 1.0 ELSE 0.5 END + 0.05::DOUBLE * 0.5 + 0.05::DOUBLE * 0.5 + 0.05::DOUBLE * coalesce(ctr, 0.1::DOUBLE) + 0.05::DOUBLE * coalesce(conversion, 0.1::DOUBLE), 5) AS score FROM g LEFT JOIN fl USING (file_id))"


@query("ltr_linear_rank", f"{_LTR}, k AS (SELECT query_id, file_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS place FROM l) SELECT * FROM k WHERE place <= 10")
def _(spark, d):
    x = learned(spark, d).select("query_id", "file_id", F.round(ranking.linear_score(), 5).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id")).cast("long")
    return x.withColumn("place", place).filter("place <= 10")


@query("pairwise_loss", f"{_LTR} SELECT a.query_id, count(*) AS pairs, round(avg(CASE WHEN a.label > b.label THEN -ln(1 / (1 + exp(-(a.score - b.score))) + 1e-8) WHEN a.label < b.label THEN -ln(1 - 1 / (1 + exp(-(a.score - b.score))) + 1e-8) ELSE 0 END), 6) AS loss FROM l a JOIN l b ON a.query_id = b.query_id AND a.file_id < b.file_id GROUP BY a.query_id")
def _(spark, d):
    return ranking.pairwise_loss(learned(spark, d).select("query_id", "file_id", "label", F.round(ranking.linear_score(), 5).alias("score")))


@query("ltr_evaluation", f"""{_LTR}, z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rs, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, file_id) AS rl,
  rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 AS ks, rank() OVER (PARTITION BY query_id ORDER BY label) + (count(*) OVER (PARTITION BY query_id, label) - 1) / 2.0 AS kl FROM l)
  SELECT query_id, count(*) AS n, round(avg((score - label) * (score - label)), 6) AS mse, round(avg(abs(score - label)), 6) AS mae, round(coalesce(sum(label / log2(rs + 1)) / nullif(sum(label / log2(rl + 1)), 0), 0), 6) AS ndcg, round(corr(ks, kl), 6) + 0.0::DOUBLE AS spearman FROM z GROUP BY query_id""")
def _(spark, d):
    return ranking.evaluate(learned(spark, d).select("query_id", "file_id", "label", F.round(ranking.linear_score(), 5).alias("score")))


@query("ltr_training")
def _(spark, d):
    w = ranking.train_linear(learned(spark, d).select("query_id", "label", *ranking.FEATURES), iterations=3)
    return spark.createDataFrame(list(w.items()), "feature string, weight double")


# --- explanations -----------------------------------------------------------------------------------------------------


def explained(spark: SparkSession, d: str) -> DataFrame:
    x = hits(spark, d)
    c = explain.confidence(F.col("score"), F.col("rank") - 1, F.count("*").over(ranking.of_list()), F.col("n"), F.when(F.col("source") == "lab", 1.0).otherwise(0.7))
    return x.withColumn("confidence", F.round(c, 6))


_CONF = f"{_HITS}, k AS (SELECT *, round(0.5::DOUBLE * exp(-score) + 0.2::DOUBLE * (1 - (rank - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY query_id), 10)) + 0.2::DOUBLE * CASE WHEN n > 100 THEN 1.0 WHEN n > 50 THEN 0.8 WHEN n > 20 THEN 0.6 WHEN n > 10 THEN 0.4 ELSE 0.2 END + 0.1::DOUBLE * CASE WHEN source = 'lab' THEN 1.0 ELSE 0.7 END, 6) AS confidence FROM h)"


@query("confidence", f"{_CONF} SELECT query_id, file_id, confidence, CASE WHEN confidence >= 0.9 THEN 'very high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.25 THEN 'low' ELSE 'very low' END AS level, CASE WHEN score < 0.4 THEN 'nearly identical' WHEN score < 0.7 THEN 'very similar' WHEN score < 1.1 THEN 'similar' WHEN score < 1.6 THEN 'somewhat similar' ELSE 'different' END AS phrase FROM k")
def _(spark, d):
    return explained(spark, d).select("query_id", "file_id", "confidence", explain.level(F.col("confidence")).alias("level"), explain.distance_phrase(F.col("score")).alias("phrase"))


@query("concerns", f"{_CONF} SELECT query_id, file_id, concat_ws(',', CASE WHEN confidence < 0.5 THEN 'low confidence' END, CASE WHEN score > 1.0 THEN 'far' END, CASE WHEN rank > 5 THEN 'low rank' END, CASE WHEN n < 20 THEN 'few examples' END) AS concerns FROM k")
def _(spark, d):
    return explained(spark, d).select("query_id", "file_id", explain.concerns(F.col("confidence"), F.col("score"), F.col("rank"), F.col("n")).alias("concerns"))


@query("flagship_search", f"{_BLEND}, kk AS (SELECT query_id, file_id, confidence FROM ({_CONF.replace('x AS (', 'WITH x2 AS (SELECT 1), x AS (', 1)} SELECT query_id, file_id, confidence FROM k)) SELECT f.query_id, f.place, f.file_id, f.species, f.source, f.final, kk.confidence FROM f JOIN kk USING (query_id, file_id) WHERE place <= 10")
def _(spark, d):
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "file_id")).cast("long")
    c = explain.confidence(F.col("score"), F.col("rank") - 1, F.count("*").over(ranking.of_list()), F.col("n"), F.when(F.col("source") == "lab", 1.0).otherwise(0.7))
    return blended(spark, d).withColumn("confidence", F.round(c, 6)).withColumn("place", place).filter("place <= 10").select("query_id", "place", "file_id", "species", "source", "final", "confidence")


# --- validation -------------------------------------------------------------------------------------------------------

_RULES = {
    "missing": ("critical", "size IS NULL"), "too_small": ("error", "size < 1024"), "too_large": ("warning", "size > 10485760"), "low_resolution": ("error", "least(width, height) < 224"),
    "high_resolution": ("warning", "greatest(width, height) > 4096"), "aspect": ("warning", "width / nullif(height, 0)::DOUBLE < 0.5 OR width / nullif(height, 0)::DOUBLE > 2"), "blank": ("error", "intensity < 5 OR intensity > 250"),
    "no_species": ("error", "trim(coalesce(species, '')) = ''"), "short_species": ("warning", "length(trim(species)) BETWEEN 1 AND 2"),
}
_ISSUES = " UNION ALL ".join(f"SELECT file_id, '{r}' AS rule, '{s}' AS severity FROM assets WHERE {w}" for r, (s, w) in _RULES.items())


def found(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return assets(spark, d).withColumn("issues", quality.issues(c("size"), c("width"), c("height"), c("intensity"), c("species")))


@query("validate_assets", _ISSUES)
def _(spark, d):
    return found(spark, d).select("file_id", F.explode("issues").alias("x")).select("file_id", "x.rule", "x.severity")


_VERDICT = f"u AS ({_ISSUES}), s AS (SELECT a.file_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning FROM assets a LEFT JOIN u USING (file_id) GROUP BY a.file_id), z AS (SELECT *, greatest(0, 100 - 50 * critical - 20 * error - 5 * warning) AS score FROM s)"


@query("asset_verdicts", f"{_VERDICT} SELECT file_id, critical, error, warning, score, score >= 50 AND critical = 0 AS valid, critical = 0 AND error = 0 AS acceptable FROM z")
def _(spark, d):
    x = F.col("issues")
    counts = [quality.count_of(x, s).cast("long").alias(s) for s in ("critical", "error", "warning")]
    return found(spark, d).select("file_id", *counts, quality.score(x).cast("long").alias("score"), quality.valid(x).alias("valid"), quality.acceptable(x).alias("acceptable"))


@query("validation_stats", f"{_VERDICT} SELECT count(*) AS total, count(*) FILTER (score >= 50 AND critical = 0) AS valid, round(avg(score), 6) AS mean_score, CAST(sum(critical + error + warning) AS BIGINT) AS issues FROM z")
def _(spark, d):
    x = F.col("issues")
    return found(spark, d).agg(F.count("*").alias("total"), F.count_if(quality.valid(x)).alias("valid"), F.round(F.avg(quality.score(x)), 6).alias("mean_score"), F.sum(F.size(x)).alias("issues"))


@query("exact_duplicates", "x AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS holder FROM documents WHERE text IS NOT NULL) SELECT * FROM x WHERE holder IS NOT NULL")
def _(spark, d):
    return quality.duplicates(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", F.col("text"))


@query("sampled_candidates", "SELECT file_id FROM (SELECT file_id, -ln(('0x' || substr(md5(CAST(file_id AS STRING) || '|42'), 1, 12))::BIGINT::DOUBLE / 281474976710657 + 1.0 / 281474976710657) AS k FROM items) ORDER BY k, file_id LIMIT 100")
def _(spark, d):
    return maintenance.weighted_sample(items(spark, d).select("file_id"), "file_id", F.lit(1.0), 100)


@query("hourly_ctr", "SELECT date_trunc('hour', created_at) AS hour, count(*) AS events, round(avg(CASE WHEN feedback_type IN ('clicked', 'selected') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS ctr FROM feedback GROUP BY 1")
def _(spark, d):
    hit = F.when(F.col("feedback_type").isin("clicked", "selected"), 1.0).otherwise(0.0)
    return events(spark, d).groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("events"), F.round(F.avg(hit), 6).alias("ctr"))
