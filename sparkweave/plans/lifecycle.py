"""Registered queries over requests, the index's life, explanations in words, adaptive and sampled search, training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.functions import vectors as V
from sparkweave.operators import explain, feedback, knn, maintenance, memo, quality, ranking, requests
from sparkweave.plans.catalog import _CONF, _COS, _HITS, _IDF, _ISSUES, _LABELS, _NORM, _ROCCHIO, FEEDBACK, asked, assets, corpus, events, explained, found, hits, items, learned, query, relevant

# --- requests and lookups ---------------------------------------------------------------------------------------------

_REQUEST = "event_id, event_id % 120 AS k, CASE event_id % 6 WHEN 0 THEN 'cosine' WHEN 1 THEN 'l2' WHEN 2 THEN 'l1' WHEN 3 THEN 'angular' WHEN 4 THEN 'inner_product' ELSE 'hamming' END AS metric, event_id % 13 / 10.0D AS weight, event_id * 1000L AS upload"


@query("request_errors", f"x AS (SELECT {_REQUEST.replace('10.0D', '10.0::DOUBLE').replace('1000L', '1000')} FROM events) SELECT event_id, concat_ws(',', CASE WHEN k NOT BETWEEN 1 AND 100 THEN 'top_k' END, CASE WHEN metric = 'hamming' THEN 'metric' END, CASE WHEN weight > 1 THEN 'weight' END, CASE WHEN upload > 10485760 THEN 'upload' END) AS errors FROM x")
def _(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").selectExpr(*_REQUEST.split(", "))
    c = F.col
    return x.select("event_id", F.array_join(requests.errors(c("k"), c("metric"), c("weight"), c("upload")), ",").alias("errors"))


@query("metric_info", "SELECT * FROM (VALUES ('cosine', false, true), ('inner_product', false, false), ('l2', true, true), ('l1', true, false), ('angular', true, true)) t(metric, ascending, normalised)")
def _(spark, d):
    return spark.createDataFrame([(m, *x) for m, x in requests.METRIC_INFO.items()], "metric string, ascending boolean, normalised boolean")


@query("items_for_ranking", "SELECT file_id, species, source, image_path, segmented_path, faiss_id FROM items WHERE file_id IN (SELECT file_id FROM feedback)")
def _(spark, d):
    wanted = events(spark, d).select("file_id").distinct()
    return items(spark, d).join(wanted, "file_id", "left_semi").select("file_id", "species", "source", "image_path", "segmented_path", "faiss_id")


@query("prefetch_counts", "SELECT count(*) AS asked, count(i.file_id) AS found, count(*) - count(i.file_id) AS missing FROM (SELECT DISTINCT file_id FROM feedback) f LEFT JOIN items i USING (file_id)")
def _(spark, d):
    x = events(spark, d).select("file_id").distinct().join(items(spark, d).select("file_id", F.lit(1).alias("here")), "file_id", "left")
    return x.agg(F.count("*").alias("asked"), F.count("here").alias("found"), (F.count("*") - F.count("here")).alias("missing"))


@query("feedback_of_query", "SELECT id, file_id, position, feedback_type FROM feedback WHERE query_hash = md5('7')")
def _(spark, d):
    return events(spark, d).filter("query_hash = md5('7')").select("id", "file_id", "position", "feedback_type")


@query("display_paths", "SELECT file_id, s AS use_segmented, CASE WHEN s THEN coalesce(segmented_path, image_path) ELSE image_path END AS path FROM items, (VALUES (true), (false)) t(s)")
def _(spark, d):
    both = items(spark, d).withColumn("use_segmented", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select("file_id", "use_segmented", F.when(F.col("use_segmented"), F.coalesce("segmented_path", "image_path")).otherwise(F.col("image_path")).alias("path"))


@query("species_exists", "SELECT name, EXISTS (SELECT 1 FROM items WHERE species = name) AS here FROM (VALUES ('species 1'), ('species 3'), ('nowhere')) t(name)")
def _(spark, d):
    names = spark.createDataFrame([("species 1",), ("species 3",), ("nowhere",)], "name string")
    there = items(spark, d).select(F.col("species").alias("name"), F.lit(True).alias("here")).distinct()
    return names.join(there, "name", "left").select("name", F.coalesce("here", F.lit(False)).alias("here"))


@query("health_summary", "SELECT (SELECT count(*) FROM items) AS items, (SELECT count(DISTINCT species) FROM items) AS species, (SELECT count(*) FROM feedback) AS feedback, (SELECT count(*) FROM items WHERE faiss_id IS NOT NULL) AS indexed, (SELECT count(*) FROM items WHERE faiss_id IS NOT NULL) * 2 > (SELECT count(*) FROM items) AS index_ok")
def _(spark, d):
    x = items(spark, d).agg(F.count("*").alias("items"), F.count_distinct("species").alias("species"), F.count("faiss_id").alias("indexed"))
    return x.crossJoin(events(spark, d).agg(F.count("*").alias("feedback"))).select("items", "species", "feedback", "indexed", (F.col("indexed") * 2 > F.col("items")).alias("index_ok"))  # one row each


# --- windows and scalars ----------------------------------------------------------------------------------------------


@query("minmax_unchanged", "x AS (SELECT query_hash, id, CAST(position AS DOUBLE) AS p, max(position) OVER w AS hi, min(position) OVER w AS lo FROM feedback WINDOW w AS (PARTITION BY query_hash)) SELECT query_hash, id, round(CASE WHEN hi > lo THEN (p - lo) / (hi - lo) ELSE p END, 6) AS x FROM x")
def _(spark, d):
    e = events(spark, d).withColumn("query_id", F.col("query_hash")).withColumn("p", F.col("position").cast("double"))
    return e.select("query_hash", "id", F.round(ranking.min_max(F.col("p"), F.col("p")), 6).alias("x"))


@query("position_weights", f"{_HITS} SELECT query_id, file_id, round(1.0::DOUBLE / rank, 6) AS weight, round(exp(-score) / rank, 6) AS product FROM h")
def _(spark, d):
    x = hits(spark, d)
    weight, product = ranking.by_position(F.exp(-F.col("score")), Window.partitionBy("query_id").orderBy("rank"))
    return x.select("query_id", "file_id", F.round(weight, 6).alias("weight"), F.round(product, 6).alias("product"))


@query("iso_times", "SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS at FROM feedback")
def _(spark, d):
    return events(spark, d).select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("score_buckets", f"{_HITS} SELECT round(score, 1) AS bucket, count(*) AS n FROM h GROUP BY 1")
def _(spark, d):
    return hits(spark, d).groupBy(F.round("score", 1).alias("bucket")).agg(F.count("*").alias("n"))


@query("merged_parameters", "SELECT file_id, 'a' AS name, 1 AS value FROM items WHERE file_id % 2 = 1 UNION ALL SELECT file_id, 'a', file_id FROM items WHERE file_id % 2 = 0 UNION ALL SELECT file_id, 'b', 2 FROM items")
def _(spark, d):
    old = F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.lit(2).cast("long"))
    new = F.when(F.col("file_id") % 2 == 0, F.create_map(F.lit("a"), F.col("file_id"))).otherwise(F.create_map().cast("map<string,bigint>"))
    return items(spark, d).select("file_id", F.explode(maintenance.merged(old, new)).alias("name", "value"))


@query("feature_vectors", "x AS (SELECT file_id, generate_subscripts(v, 1) - 1 AS i, unnest(list_transform(v, lambda e: e / (sqrt(list_inner_product(v, v)) + 1e-8))) AS e FROM vec), z AS (SELECT file_id, i, (e - avg(e) OVER w) / (stddev_pop(e) OVER w + 1e-8) AS e FROM x WINDOW w AS (PARTITION BY file_id)) SELECT file_id, i, round(e / (sqrt(sum(e * e) OVER (PARTITION BY file_id)) + 1e-8), 5) AS x FROM z")
def _(spark, d):
    return corpus(spark, d).select("file_id", F.posexplode(V.features(F.col("v"))).alias("i", "e")).select("file_id", F.col("i").cast("long").alias("i"), F.round("e", 5).alias("x"))


@query("feature_space_check", f"x AS (SELECT file_id, v, list_transform(v, lambda e: e / {_NORM.format('v')}) AS u FROM vec) SELECT file_id, round(list_max(list_transform(list_zip(v, u), lambda p: abs(p[1] - p[2]))), 5) AS most, round(list_avg(list_transform(list_zip(v, u), lambda p: abs(p[1] - p[2]))), 5) AS mean, list_max(list_transform(list_zip(v, u), lambda p: abs(p[1] - p[2]))) < 0.001 AS same FROM x")
def _(spark, d):
    """Stored vectors against those that the extractor's normalisation would make of them."""
    gap = F.zip_with(V.dbl(F.col("v")), V.unit(F.col("v")), lambda a, b: F.abs(a - b))
    x = corpus(spark, d).select("file_id", F.array_max(gap).alias("most"), V.mean(gap).alias("mean"))
    return x.select("file_id", F.round("most", 5).alias("most"), F.round("mean", 5).alias("mean"), (F.col("most") < 0.001).alias("same"))


# --- explanations in words --------------------------------------------------------------------------------------------

_SCORES = {"distance": "0.5::DOUBLE * exp(-score)", "rank": "0.2::DOUBLE * (1 - (rank - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY query_id), 10))", "support": "0.2::DOUBLE * CASE WHEN n > 100 THEN 1.0 WHEN n > 50 THEN 0.8 WHEN n > 20 THEN 0.6 WHEN n > 10 THEN 0.4 ELSE 0.2 END", "source": "0.1::DOUBLE * CASE WHEN source = 'lab' THEN 1.0 ELSE 0.7 END"}
_LEVEL = "CASE WHEN confidence >= 0.9 THEN 'very high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.25 THEN 'low' ELSE 'very low' END"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    x = explained(spark, d)
    return x.withColumn("parts", explain.parts(F.col("score"), F.col("rank") - 1, F.count("*").over(ranking.of_list()), F.col("n"), F.when(F.col("source") == "lab", 1.0).otherwise(0.7)))


@query("confidence_parts", f"{_HITS}, u AS (SELECT query_id, file_id, {', '.join(f'{e} AS {n}_' for n, e in _SCORES.items())} FROM h) " + " UNION ALL ".join(f"SELECT query_id, file_id, '{n}' AS part, round({n}_, 6) AS contribution FROM u" for n in _SCORES))
def _(spark, d):
    return _parts(spark, d).select("query_id", "file_id", F.explode("parts").alias("x")).select("query_id", "file_id", "x.part", F.round("x.contribution", 6).alias("contribution"))


@query("explanation_sentences", f"{_CONF} SELECT query_id, file_id, printf('Match of %s confidence: %s at distance %.3f', {_LEVEL}, species, round(score, 3)) AS text FROM k")
def _(spark, d):
    return explained(spark, d).select("query_id", "file_id", explain.sentence(explain.level(F.col("confidence")), F.col("species"), F.col("score")).alias("text"))


@query("compared_results", f"""{_CONF}, u AS (SELECT query_id, rank, file_id, confidence, {', '.join(f'{e} AS {n}_' for n, e in _SCORES.items())} FROM k),
  p AS (SELECT a.query_id, a.file_id AS a, b.file_id AS b, a.confidence - b.confidence AS gap, {', '.join(f'round(abs(a.{n}_ - b.{n}_), 6) AS {n}_' for n in _SCORES)} FROM u a JOIN u b ON a.query_id = b.query_id AND b.rank = a.rank + 1)
  SELECT query_id, a, b, CASE WHEN abs(gap) < 0.05 THEN 'tie' WHEN gap > 0 THEN 'a' ELSE 'b' END AS better, CASE greatest({', '.join(f'{n}_' for n in _SCORES)}) {' '.join(f"WHEN {n}_ THEN '{n}'" for n in _SCORES)} END AS differs_in FROM p""")  # fmt: skip
def _(spark, d):
    x = _parts(spark, d)
    a = x.select("query_id", "rank", F.col("file_id").alias("a"), F.col("confidence").alias("confidence_a"), F.col("parts").alias("parts_a"))
    b = x.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("file_id").alias("b"), F.col("confidence").alias("confidence_b"), F.col("parts").alias("parts_b"))
    return explain.compare(a.join(b, ["query_id", "rank"])).select("query_id", "a", "b", "better", "differs_in")


@query("explanations_json", f"{_CONF} SELECT query_id, file_id, '{{\"file_id\":' || file_id || ',\"level\":\"' || {_LEVEL} || '\",\"rank\":' || rank || '}}' AS json FROM k")
def _(spark, d):
    return explained(spark, d).select("query_id", "file_id", explain.as_json({"file_id": F.col("file_id"), "level": explain.level(F.col("confidence")), "rank": F.col("rank")}).alias("json"))


# --- adaptive, sampled and refined search -----------------------------------------------------------------------------

_KINDS = "kd AS (SELECT file_id AS query_id, CASE WHEN round(list_stddev_pop(v), 9) > 0.15 AND list_max(v) > 2 THEN 'specific' WHEN round(list_stddev_pop(v), 9) < 0.08 THEN 'general' ELSE 'ambiguous' END AS kind FROM vec WHERE file_id % 20 = 0), wt(kind, a, b, c, e) AS (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in w)})" for k, w in ranking.WEIGHTS.items()) + ")"


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return ranking.weights_by_kind(asked(spark, d).select("query_id", ranking.query_kind(F.round(V.deviation(v), 9), F.array_max(V.dbl(v))).alias("kind")))


@query("adaptive_weights", f"{_KINDS} SELECT query_id, kind, a AS vector, b AS prior, c AS origin, e AS variety FROM kd JOIN wt USING (kind)")
def _(spark, d):
    return _kinds(spark, d).select("query_id", "kind", "vector", "prior", "origin", "variety")


@query("adaptive_search", f"{_IDF}, {_KINDS}, b AS (SELECT p.query_id, p.file_id, round((wt.a * soft + wt.b * prior + wt.c * CASE WHEN source = preferred THEN 1.0 ELSE 0.7 END + wt.e) / (wt.a + wt.b + wt.c + wt.e), 6) AS final FROM p JOIN t USING (query_id) JOIN kd USING (query_id) JOIN wt USING (kind)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, file_id) AS place FROM b QUALIFY place <= 10")
def _(spark, d):
    x = hits(spark, d)
    x = x.join(ranking.source_vote(x), "query_id").join(_kinds(spark, d).drop("kind"), "query_id")
    final = ranking.adaptive_blend(ranking.tempered_softmax(F.col("score")), ranking.idf_prior(F.col("n")), ranking.source_score(F.col("source"), F.col("preferred")), F.lit(1.0))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "file_id")).cast("long")
    return x.select("query_id", "file_id", F.round(final, 6).alias("final")).withColumn("place", place).filter("place <= 10")


@query("sampled_rerank", f"""{_HITS}, u AS (SELECT *, round(-ln((('0x' || substr(md5(concat_ws('|', query_id, file_id, 42)), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657) / (max(score) OVER (PARTITION BY query_id) - score + 1e-8::DOUBLE), 6) AS draw, count(*) OVER (PARTITION BY query_id) AS size FROM h),
  w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY draw, file_id) <= greatest(10, floor(size * 0.3::DOUBLE)) THEN round(2 - score, 6) END AS reranked FROM u),
  p AS (SELECT a.query_id, a.file_id, abs(a.score - b.score) AS d, b.reranked, row_number() OVER (PARTITION BY a.query_id, a.file_id ORDER BY abs(a.score - b.score), b.file_id) AS n FROM w a JOIN w b ON a.query_id = b.query_id WHERE a.reranked IS NULL AND b.reranked IS NOT NULL),
  f AS (SELECT query_id, file_id, round(reranked, 6) AS final FROM w WHERE reranked IS NOT NULL UNION ALL SELECT query_id, file_id, round(sum(reranked / (d + 1e-8::DOUBLE)) / sum(1 / (d + 1e-8::DOUBLE)), 6) FROM p WHERE n <= 10 GROUP BY ALL)
  SELECT query_id, file_id, final FROM f""")  # fmt: skip
def _(spark, d):
    return ranking.sampled_rerank(hits(spark, d), F.round(2 - F.col("score"), 6), least=10).drop("place")


@query("refined_search", _ROCCHIO.split("  SELECT query_id, i, round(CASE")[0] + f""",
  rv AS (SELECT query_id, list(round(CASE WHEN seen AND n > 0 THEN y / n ELSE e END, 6) ORDER BY i) AS v FROM n GROUP BY query_id),
  sc AS (SELECT q.query_id, c.file_id, round({_COS}, 6) AS score FROM rv q, vec c)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank, file_id, score FROM sc QUALIFY rank <= 10""")  # fmt: skip
def _(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").selectExpr("(user_id % 40) * 20 AS query_hash", f"{FEEDBACK['file_id']} AS file_id", f"{FEEDBACK['feedback_type']} AS feedback_type")
    judged = feedback.judgments(raw).withColumnRenamed("query_hash", "query_id")
    elements = feedback.refine(asked(spark, d), judged, corpus(spark, d))
    refined = elements.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    return knn.search(corpus(spark, d), refined, "cosine", 10)


@query("plain_order", f"x AS (SELECT q.file_id AS query_id, c.file_id, round({_COS}, 6) AS relevance FROM vec q, vec c WHERE q.file_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, file_id) AS position FROM x) SELECT query_id, position, file_id FROM r WHERE position <= 10")
def _(spark, d):
    """What the facade does for the kinds that have no method of their own."""
    return ranking.diversify(relevant(spark, d), "dpp")


# --- the index's life -------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(index of the items that have a place in it, the others)."""
    x = corpus(spark, d).join(items(spark, d).select("file_id", "faiss_id"), "file_id").withColumn("v", V.normalised_for("cosine", F.col("v")))
    return maintenance.numbered(x.filter("faiss_id IS NOT NULL").select("file_id", "v"), "file_id"), x.filter("faiss_id IS NULL").select("file_id", "v")


_SLOTS = "sl AS (SELECT file_id, faiss_id IS NULL AS added, row_number() OVER (ORDER BY faiss_id IS NULL, file_id) - 1 AS slot FROM items)"


@query("index_slots", f"{_SLOTS} SELECT file_id, slot FROM sl")
def _(spark, d):
    index, new = _index(spark, d)
    return maintenance.appended(index, new, "file_id").select("file_id", "slot")


@query("index_state", f"{_SLOTS}, u AS (SELECT slot, round(list_inner_product(v, v) / ({_NORM.format('v')} * {_NORM.format('v')}), 4) AS s FROM sl JOIN vec USING (file_id)) SELECT count(*) AS vectors, max(slot) AS last, count(*) FILTER (s BETWEEN 0.999 AND 1.001) AS units FROM u")
def _(spark, d):
    index, new = _index(spark, d)
    all_ = maintenance.appended(index, new, "file_id").withColumn("s", F.round(V.dot(F.col("v"), F.col("v")), 4))
    return all_.agg(F.count("*").alias("vectors"), F.max("slot").alias("last"), F.count_if(F.col("s").between(0.999, 1.001)).alias("units"))


for _m in ("l1", "angular"):

    @query(f"index_rebuilt_{_m}", f"SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS slot, round({'sqrt(list_inner_product(v, v))' if _m == 'l1' else 'sqrt(list_inner_product(v, v)) / ' + _NORM.format('v')}, 5) AS norm FROM vec")
    def _(spark, d, m=_m):
        x = corpus(spark, d).withColumn("v", V.normalised_for(m, F.col("v")))
        return maintenance.numbered(x, "file_id").select("file_id", "slot", F.round(V.norm(F.col("v")), 5).alias("norm"))


@query("index_deleted", f"{_SLOTS} SELECT file_id, slot FROM sl WHERE NOT added AND file_id NOT IN (SELECT file_id FROM feedback WHERE feedback_type = 'dismissed')")
def _(spark, d):
    gone = events(spark, d).filter("feedback_type = 'dismissed'").select("file_id").distinct()
    return _index(spark, d)[0].join(gone, "file_id", "left_anti").select("file_id", "slot")


@query("sync_counts", "SELECT count(*) AS total, count(faiss_id) AS indexed, count(*) FILTER (faiss_id IS NULL) AS missing, count(*) FILTER (faiss_id IS NULL AND file_id % 2 = 1) AS added, count(*) FILTER (faiss_id IS NULL AND file_id % 2 = 0) AS failed FROM items")
def _(spark, d):
    x = items(spark, d)
    return maintenance.sync_counts(x, x.filter("faiss_id IS NOT NULL"), x.filter("file_id % 2 = 0"), "file_id")


@query("feedback_recorded", "SELECT id, file_id, feedback_type FROM feedback UNION ALL SELECT (SELECT max(id) + 1 FROM feedback) + row_number() OVER (ORDER BY file_id) - 1, file_id, 'clicked' FROM items")
def _(spark, d):
    new = items(spark, d).select("file_id", F.lit("clicked").alias("feedback_type"))
    return maintenance.record(events(spark, d).select("id", "file_id", "feedback_type"), new, "id", "file_id")


@query("buffered_batches", "x AS (SELECT (row_number() OVER (ORDER BY file_id) - 1) // 32 AS buffer FROM items) SELECT buffer, count(*) AS n FROM x GROUP BY buffer")
def _(spark, d):
    return maintenance.in_buffers(items(spark, d).select("file_id"), "file_id", 32).groupBy("buffer").agg(F.count("*").alias("n"))


_LEVELS = "a AS (SELECT event_id, user_id AS key FROM events), one AS (SELECT vec_id AS key, label AS value FROM embeddings WHERE label % 2 = 0), two AS (SELECT vec_id AS key, label + 100 AS value FROM embeddings), j AS (SELECT event_id, a.key, coalesce(one.value, two.value) AS value, CASE WHEN one.key IS NOT NULL THEN 'first' WHEN two.key IS NOT NULL THEN 'second' ELSE 'miss' END AS level FROM a LEFT JOIN one ON one.key = a.key LEFT JOIN two ON two.key = a.key)"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    stored = F.when(F.col("value") % 2 == 0, now).otherwise(now - F.expr("INTERVAL 2 HOURS"))  # those of odd labels have run out
    entries = lambda value, at: memo.entries(e.select(F.col("vec_id").alias("key"), value.alias("value")), at, 3600)
    return memo.two_levels(spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").alias("key")), entries(F.col("label"), stored), entries(F.col("label") + 100, now), now)


@query("cache_levels", f"{_LEVELS} SELECT event_id, key, value, level FROM j")
def _(spark, d):
    return _two(spark, d)[0].select("event_id", "key", "value", "level")


@query("cache_promoted", f"{_LEVELS} SELECT DISTINCT key, value FROM j WHERE level = 'second'")
def _(spark, d):
    return _two(spark, d)[1].select("key", "value")


# --- validation -------------------------------------------------------------------------------------------------------

_SHOWN = {"format": "CASE p_partkey % 7 WHEN 0 THEN 'gif' WHEN 1 THEN 'png' ELSE 'JPEG' END", "blur": "CAST(p_partkey % 90 AS DOUBLE)", "brightness": "CAST(p_partkey * 7 % 100 AS DOUBLE)", "contrast": "CAST(p_partkey % 50 AS DOUBLE)", "content": "CAST(p_partkey % 101 AS DOUBLE)"}
_PICTURE = "sh AS (SELECT p_partkey AS file_id, " + ", ".join(f"{e} AS {n}" for n, e in _SHOWN.items()) + " FROM part)"
_PICTURE_RULES = {"format": ("error", "upper(format) NOT IN ('JPEG', 'PNG', 'JPG')"), "blurred": ("warning", "blur < 20"), "dark": ("warning", "brightness < 20"), "bright": ("warning", "brightness > 80"), "flat": ("warning", "contrast < 15")}
_PICTURE_ISSUES = " UNION ALL ".join(f"SELECT file_id, '{r}' AS rule, '{s}' AS severity FROM sh WHERE {w}" for r, (s, w) in _PICTURE_RULES.items())


def _shown(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS file_id", *[f"{e} AS {n}" for n, e in _SHOWN.items()])
    return x.withColumn("shown", quality.picture_issues(c("format"), c("blur"), c("brightness"), c("contrast")))


@query("validate_pictures", f"{_PICTURE} {_PICTURE_ISSUES}")
def _(spark, d):
    return _shown(spark, d).select("file_id", F.explode("shown").alias("x")).select("file_id", "x.rule", "x.severity")


_FULL = f"""{_PICTURE}, iss AS ({_ISSUES} UNION ALL {_PICTURE_ISSUES}), s AS (SELECT file_id, 50 * count(*) FILTER (severity = 'critical') + 20 * count(*) FILTER (severity = 'error') + 5 * count(*) FILTER (severity = 'warning') AS lost, count(*) FILTER (severity = 'critical') AS critical FROM iss GROUP BY file_id),
  z AS (SELECT a.file_id, a.species, coalesce(critical, 0) AS critical, CAST(CASE WHEN a.size IS NULL THEN 0 ELSE greatest(0, greatest(0, 100 - coalesce(lost, 0)) - CASE WHEN blur < 30 THEN 10 ELSE 0 END - CASE WHEN content < 40 THEN 15 ELSE 0 END) END AS BIGINT) AS score FROM assets a JOIN sh USING (file_id) LEFT JOIN s USING (file_id))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    x = found(spark, d).join(_shown(spark, d), "file_id").withColumn("all", F.concat("issues", "shown"))
    return x.withColumn("score", quality.full_score(F.col("all"), F.col("size"), F.col("blur"), F.col("content")).cast("long"))


@query("asset_scores", f"{_FULL} SELECT file_id, score FROM z")
def _(spark, d):
    return _scored(spark, d).select("file_id", "score")


@query("valid_duplicates", f"{_FULL}, y AS (SELECT file_id, last_value(CASE WHEN score >= 50 AND critical = 0 THEN file_id END IGNORE NULLS) OVER (PARTITION BY species ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder FROM z) SELECT * FROM y WHERE holder IS NOT NULL")
def _(spark, d):
    x = _scored(spark, d)
    return quality.valid_duplicates(x, "file_id", F.col("species"), (F.col("score") >= quality.LEAST_SCORE) & (quality.count_of(F.col("all"), "critical") == 0))


# --- training ---------------------------------------------------------------------------------------------------------

_KNOWN = {"vector_similarity": "exp(-score)", "cosine_similarity": "1 - score * score / 2", "l2_distance": "score", "species_frequency": "n / total::DOUBLE", "source_score": "CASE WHEN source = 'lab' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"}
_ROWS = f"{_HITS}, g AS (SELECT *, (SELECT count(*) FROM items) AS total FROM h), {_LABELS}, l AS (SELECT query_id, file_id, coalesce(label, 0) AS label, {', '.join(f'{e} AS {n}' for n, e in _KNOWN.items())} FROM g LEFT JOIN fl USING (file_id))"
_START = {n: ranking.FEATURES[n] for n in _KNOWN}
_SCORE = " + ".join(f"({w}::DOUBLE) * {{0}}{n}" for n, w in _START.items())


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return learned(spark, d).select("query_id", "file_id", "label", *_KNOWN)


@query("ltr_feedback_features", "fs AS (SELECT file_id, avg(CASE WHEN feedback_type IN ('clicked', 'selected') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ctr, avg(CASE WHEN feedback_type = 'selected' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS conversion FROM feedback GROUP BY file_id) SELECT i.file_id, round(coalesce(ctr, 0.1::DOUBLE), 6) AS click_through_rate, round(coalesce(conversion, 0.1::DOUBLE), 6) AS conversion_rate FROM items i LEFT JOIN fs USING (file_id)")
def _(spark, d):
    """Rates of the items' own feedback; the defaults where there is none."""
    x = items(spark, d).select("file_id").join(feedback.file_stats(events(spark, d)), "file_id", "left")
    return x.select("file_id", F.coalesce("ctr", F.lit(ranking.DEFAULTS["click_through_rate"])).alias("click_through_rate"), F.coalesce("conversion", F.lit(ranking.DEFAULTS["conversion_rate"])).alias("conversion_rate"))


@query("ltr_synthetic_labels", f"{_ROWS} SELECT query_id, file_id, round(greatest(0, least(5, 5 * (0.3::DOUBLE * vector_similarity + 0.2::DOUBLE * cosine_similarity + 0.2::DOUBLE * (1 - l2_distance) + 0.1::DOUBLE * species_frequency + 0.1::DOUBLE * 0.8 + 0.1::DOUBLE * source_score))), 6) AS label FROM l")
def _(spark, d):
    c = F.col
    x = ranking.synthetic_label(c("vector_similarity"), c("cosine_similarity"), c("l2_distance"), c("species_frequency"), F.lit(0.8), c("source_score"))
    return _rows(spark, d).select("query_id", "file_id", F.round(x, 6).alias("label"))


@query("ltr_error", f"{_ROWS} SELECT round(avg(pow({_SCORE.format('')} - label, 2)), 6) AS mse, count(*) AS n FROM l")
def _(spark, d):
    return _rows(spark, d).agg(F.round(ranking.squared_error(_START), 6).alias("mse"), F.count("*").alias("n"))


@query("ltr_step", f"{_ROWS}, e AS (SELECT *, {_SCORE.format('')} - label AS e FROM l), q AS (SELECT query_id, {', '.join(f'2 * avg(e * {n}) AS {n}' for n in _KNOWN)} FROM e GROUP BY query_id) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round({w}::DOUBLE - 0.01::DOUBLE * avg({n}), 6) AS weight FROM q" for n, w in _START.items()))
def _(spark, d):
    w = ranking.update_online(_START, _rows(spark, d))
    return spark.createDataFrame([(n, round(x, 6)) for n, x in w.items()], "feature string, weight double")


@query("ranknet_step", f"{_ROWS}, pr AS (SELECT {', '.join(f'a.{n} - b.{n} AS {n}' for n in _KNOWN)} FROM l a JOIN l b ON a.query_id = b.query_id AND a.label > b.label), m AS (SELECT *, 1 / (1 + exp({_SCORE.format('')})) AS miss FROM pr) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round({w}::DOUBLE + 0.01::DOUBLE * avg(miss * {n}), 6) AS weight FROM m" for n, w in _START.items()))
def _(spark, d):
    kind, w = ranking.train(_rows(spark, d), "pairwise", iterations=1, start=_START)
    return spark.createDataFrame([(n, round(x, 6)) for n, x in w.items()], "feature string, weight double")


@query("ltr_validation")
def _(spark, d):
    """The curve of training on two thirds of the queries and validating on the rest."""
    x = _rows(spark, d).cache()
    _, curve = ranking.train_validated(x.filter("query_id % 60 <> 0"), x.filter("query_id % 60 = 0"), 3, start=_START)
    return spark.createDataFrame(curve, "epoch int, training double, validation double")
