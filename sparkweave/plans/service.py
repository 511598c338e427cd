"""Registered queries over what a search service reports and does: profiles, statistics, ids, ingest, deletion, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkweave.functions import vectors as V
from sparkweave.operators import augment, explain, feedback, knn, maintenance, quality, ranking, requests
from sparkweave.plans.catalog import _CONF, _HITS, _VERDICT, ORACLES, asked, corpus, events, found, hits, items, learned, query
from sparkweave.plans.catalog import _knn_sql
from sparkweave.plans.curation import _sql_steps
from sparkweave.plans.lifecycle import _LEVEL, _SLOTS, _index
from sparkweave.sources import io

# --- profiles and statistics ------------------------------------------------------------------------------------------


@query("metadata_profile", "SELECT count(*) AS total, count(DISTINCT species) AS species, count(*) FILTER (source = 'lab') AS lab, count(*) FILTER (source = 'field') AS field, count(segmented_path) AS segmented FROM items")
def _(spark, d):
    return io.profile(items(spark, d))


@query("validation_summary", f"""{_VERDICT}, y AS (SELECT a.file_id, last_value(CASE WHEN score >= 50 AND critical = 0 THEN a.file_id END IGNORE NULLS) OVER (PARTITION BY species ORDER BY a.file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder FROM z JOIN assets a USING (file_id) WHERE species IS NOT NULL)
  SELECT count(*) AS total, count(*) FILTER (score >= 50 AND critical = 0) AS valid, count(*) FILTER (critical = 0 AND error = 0) AS acceptable, round(avg(score), 6) AS mean_score, CAST(sum(critical + error + warning) AS BIGINT) AS issues, (SELECT count(holder) FROM y) AS duplicates, round(100.0::DOUBLE * count(*) FILTER (score >= 50 AND critical = 0) / count(*), 6) AS rate FROM z""")  # fmt: skip
def _(spark, d):
    return quality.statistics(found(spark, d), "file_id", "issues", F.col("species"))


@query("augmentation_summary", f"v AS (SELECT file_id, range AS version FROM items, range(2)), {_sql_steps('standard')} SELECT count(*) AS total, count(DISTINCT step) AS kinds, (SELECT step FROM drawn GROUP BY step ORDER BY count(*) DESC, step LIMIT 1) AS most FROM drawn")
def _(spark, d):
    return augment.summary(augment.plan(items(spark, d).select("file_id"), "file_id", 2))


_QUARTERS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


@query("vector_quartiles", "e AS (SELECT file_id, unnest(v) AS e FROM vec) SELECT file_id, " + ", ".join(f"round(quantile_cont(e, {p}), 6) AS {n}" for n, p in _QUARTERS.items()) + " FROM e GROUP BY file_id")
def _(spark, d):
    return corpus(spark, d).select("file_id", *[F.round(V.quantile(F.col("v"), p), 6).alias(n) for n, p in _QUARTERS.items()])


@query("graded_first_queries", "")
def _(spark, d):
    """Of the five queries that were asked first."""
    return feedback.graded_relevance(events(spark, d), 5)


ORACLES["graded_first_queries"] = ORACLES["graded_relevance"].replace("FROM feedback GROUP BY ALL", "FROM feedback WHERE query_hash IN (SELECT query_hash FROM feedback GROUP BY query_hash ORDER BY min(id), query_hash LIMIT 5) GROUP BY ALL")

# --- search -----------------------------------------------------------------------------------------------------------


@query("ltr_over_retrieval", _knn_sql("l2", 30))
def _(spark, d):
    return knn.search(corpus(spark, d), asked(spark, d), "l2", min(3 * 10, 100))


@query("preferred_sources", f"{_HITS}, t AS (SELECT query_id, CASE WHEN count(*) FILTER (source = 'lab') * 2 > count(*) THEN 'lab' ELSE 'field' END AS preferred FROM h WHERE rank <= 5 AND n > 50 GROUP BY query_id) SELECT file_id AS query_id, coalesce(preferred, CASE WHEN round(list_stddev_pop(v), 9) < 0.2 THEN 'field' ELSE 'lab' END) AS preferred FROM vec LEFT JOIN t ON query_id = file_id WHERE file_id % 20 = 0")
def _(spark, d):
    """The hits of frequent species vote."""
    return ranking.preferred_sources(hits(spark, d).filter("n > 50"), asked(spark, d))


@query("explanations", f"{_CONF} SELECT query_id, file_id, confidence, {_LEVEL} AS level, printf('Match of %s confidence: %s at distance %.3f', {_LEVEL}, species, round(score, 3)) AS text, concat_ws(',', CASE WHEN confidence < 0.5 THEN 'low confidence' END, CASE WHEN score > 1.0 THEN 'far' END, CASE WHEN rank > 5 THEN 'low rank' END, CASE WHEN n < 20 THEN 'few examples' END) AS concerns FROM k")
def _(spark, d):
    c = F.col
    x = explain.explanation(c("score"), c("rank") - 1, F.count("*").over(ranking.of_list()), c("n"), F.when(c("source") == "lab", 1.0).otherwise(0.7), c("species"))
    return hits(spark, d).select("query_id", "file_id", x.alias("x")).select("query_id", "file_id", "x.confidence", "x.level", "x.text", "x.concerns")


# --- training ---------------------------------------------------------------------------------------------------------


@query("synthetic_features", "SELECT file_id, " + ", ".join("CASE WHEN source = 'lab' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS source_score" if n == "source_score" else f"round(('0x' || substr(md5(concat_ws('|', file_id, '{n}', 42)), 1, 12))::BIGINT::DOUBLE / 281474976710656, 6) AS {n}" for n in ranking.FEATURES) + " FROM items")
def _(spark, d):
    x = ranking.synthetic_features(items(spark, d).select("file_id", "source"), "file_id", F.col("source"))
    return x.select("file_id", *[F.round(n, 6).alias(n) for n in ranking.FEATURES])


@query("training_run")
def _(spark, d):
    """Split by query, train, keep what validates best, evaluate on the test queries."""
    return ranking.run_training(learned(spark, d).select("query_id", "file_id", "label", *ranking.FEATURES).cache())[1]


# --- ids and rows as text ---------------------------------------------------------------------------------------------


@query("task_ids", "m AS (SELECT event_id, md5(concat_ws('|', 'index', event_id)) AS m FROM events) SELECT event_id, concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), '4' || substr(m, 14, 3), '8' || substr(m, 18, 3), substr(m, 21, 12)) AS task_id FROM m")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", requests.task_id(F.lit("index"), F.col("event_id").cast("string")).alias("task_id"))


@query("feedback_json", """SELECT id, '{"id":' || id || ',"query_hash":"' || query_hash || '","file_id":' || file_id || ',"feedback_type":"' || feedback_type || '","position":' || position || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}' AS json FROM feedback""")
def _(spark, d):
    names = ("id", "query_hash", "file_id", "feedback_type", "position")
    fields = {n: F.col(n) for n in names} | {"created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")}
    return events(spark, d).select("id", explain.as_json(fields).alias("json"))


# --- stores -----------------------------------------------------------------------------------------------------------


@query("deleted_everywhere", f"{_SLOTS}, gone AS (SELECT file_id FROM items WHERE milvus_id IS NULL) SELECT 'items' AS store, count(*) AS n FROM items WHERE file_id NOT IN (FROM gone) UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE file_id NOT IN (FROM gone) UNION ALL SELECT 'index', count(*) FROM sl WHERE NOT added AND file_id NOT IN (FROM gone)")
def _(spark, d):
    x = items(spark, d)
    stores = {"items": x, "feedback": events(spark, d), "index": _index(spark, d)[0]}
    left = maintenance.delete_items(x.filter("milvus_id IS NULL"), stores, "file_id")
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n") for name, rows in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("ingest_summary", "SELECT count(*) AS read, count(faiss_id) AS known, count(*) FILTER (faiss_id IS NULL AND milvus_id IS NULL) AS failed, count(*) FILTER (faiss_id IS NULL AND milvus_id IS NOT NULL) AS added, count(*) FILTER (faiss_id IS NOT NULL OR milvus_id IS NOT NULL) AS indexed FROM items")
def _(spark, d):
    """Items that are in one index already are known; those with a place in the other have a vector."""
    x = items(spark, d)
    vectors = corpus(spark, d).join(x.filter("milvus_id IS NOT NULL").select("file_id"), "file_id", "left_semi")
    return maintenance.ingest(x, vectors, x.filter("faiss_id IS NOT NULL"), _index(spark, d)[0], "file_id")[2]


@query("index_report", "n AS (SELECT count(*) AS vectors, max(len(v)) AS dimensions FROM vec JOIN items USING (file_id) WHERE faiss_id IS NOT NULL) SELECT metric, vectors, dimensions, vectors AS units, metric NOT IN ('inner_product', 'l1') AS fits FROM n, (VALUES ('cosine'), ('inner_product'), ('l2'), ('l1'), ('angular')) t(metric)")
def _(spark, d):
    """Of an index that was made for cosine."""
    unit = F.abs(V.norm(F.col("v")) - 1) < 0.001
    return maintenance.index_report(_index(spark, d)[0], unit, {m: taken for m, (_, taken) in requests.METRIC_INFO.items()})


@query("species_folders", "SELECT 'species_' || CAST(label AS VARCHAR) AS folder, bool_or(segmented_path IS NOT NULL) AS here FROM items JOIN embeddings ON vec_id = file_id GROUP BY label")
def _(spark, d):
    x = items(spark, d)
    files = x.filter("segmented_path IS NOT NULL").select(F.concat_ws("/", F.lit("data"), maintenance.slug(F.col("species")), F.concat(F.col("file_id").cast("string"), F.lit(".png"))).alias("path"))
    return maintenance.folders(x, "species", files, "path")
