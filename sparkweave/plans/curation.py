"""Registered queries over pictures, augmentation, caches, tasks, changes and files; they join those of the catalog.

A picture of 16 x 16 pixels stands for each item, by a formula that both engines have: light ground with a darker
green square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import augment, images, maintenance, memo, ranking
from sparkweave.plans.catalog import _HITS, events, hits, items, query
from sparkweave.streaming import tasks

SIDE = 16


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    y, x = np.mgrid[:SIDE, :SIDE]
    inside = (y >= 4) & (y < 12) & (x >= 4) & (x < 12)
    for b in batches:
        ids = b.column("file_id").to_pylist()
        data = []
        for i in ids:
            r = np.where(inside, 50 + i % 40, 160 + (i * 7 + y * 13 + x * 29) % 90)
            g = np.where(inside, 110 + (y * x + i) % 60, 160 + (i * 13 + y * 14 + x * 26) % 90)
            bl = np.where(inside, 50, 160 + (i * 19 + y * 15 + x * 23) % 90)
            data.append(np.stack([r, g, bl], -1).astype(np.uint8).tobytes())
        side = pa.array([SIDE] * len(ids), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("file_id"), side, side, pa.array(data, pa.binary())], names=["file_id", "height", "width", "data"])


def pictures(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("file_id").mapInArrow(_painted, "file_id bigint, height int, width int, data binary")


_IN = "y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11"
_PX = f"""px0 AS (SELECT vec_id AS file_id, y, x,
    CASE WHEN {_IN} THEN 50 + vec_id % 40 ELSE 160 + (vec_id * 7 + y * 13 + x * 29) % 90 END AS r,
    CASE WHEN {_IN} THEN 110 + (y * x + vec_id) % 60 ELSE 160 + (vec_id * 13 + y * 14 + x * 26) % 90 END AS g,
    CASE WHEN {_IN} THEN 50 ELSE 160 + (vec_id * 19 + y * 15 + x * 23) % 90 END AS b
    FROM embeddings, range({SIDE}) a(y), range({SIDE}) c(x)),
  px AS (SELECT *, (299 * r + 587 * g + 114 * b + 500) // 1000 AS v FROM px0)"""


def _at(i: str) -> str:
    """A place beyond the border, reflected."""
    return f"({SIDE - 1} - abs({SIDE - 1} - abs({i})))"


def _near(reach: int) -> str:
    return f"(SELECT p.file_id, p.y, p.x, p.v, q.v AS w, dy, dx FROM px p, range({-reach}, {reach + 1}) s(dy), range({-reach}, {reach + 1}) t(dx), px q WHERE q.file_id = p.file_id AND q.y = {_at('p.y + dy')} AND q.x = {_at('p.x + dx')})"


_QUALITY = f"""{_PX}, lap AS (SELECT file_id, y, x, sum(w) FILTER (abs(dy) + abs(dx) = 1) - 4 * any_value(v) AS l FROM {_near(1)} GROUP BY file_id, y, x),
  med AS (SELECT file_id, y, x, any_value(v) - median(w) AS h FROM {_near(2)} GROUP BY file_id, y, x),
  m AS (SELECT file_id, avg(v) AS brightness, stddev_pop(v) AS contrast, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM px GROUP BY file_id),
  q AS (SELECT m.file_id, round(l.blur, 6) AS blur, round(m.brightness, 6) AS brightness, round(m.contrast, 6) AS contrast, round(n.noise, 6) AS noise,
    round(sqrt((mr * mr + mg * mg + mb * mb) / 3 - pow((mr + mg + mb) / 3, 2)), 6) AS "cast"
    FROM m JOIN (SELECT file_id, (count(*) * sum(l * l) - sum(l) * sum(l))::DOUBLE / (count(*) * count(*)) AS blur FROM lap GROUP BY file_id) l USING (file_id) JOIN (SELECT file_id, stddev_pop(h) AS noise FROM med GROUP BY file_id) n USING (file_id))"""
_SEEN = ("blur", "brightness", "contrast", "noise", "cast")


def measured(spark: SparkSession, d: str) -> DataFrame:
    return images.quality(pictures(spark, d), "file_id").select("file_id", *[F.round(c, 6).alias(c) for c in _SEEN])


@query("image_quality", f'{_QUALITY} SELECT file_id, blur, brightness, contrast, noise, "cast" FROM q')
def _(spark, d):
    return measured(spark, d)


@query("image_catalogue_steps", f"{_QUALITY} SELECT file_id, concat_ws(',', CASE WHEN blur < 150 THEN 'denoise' END, CASE WHEN brightness < 80 OR brightness > 200 THEN 'color_balance' END, CASE WHEN contrast < 30 THEN 'clahe' END) AS steps FROM q")
def _(spark, d):
    return measured(spark, d).select("file_id", F.concat_ws(",", images.catalogue_steps()).alias("steps"))


@query("image_query_steps", f"""{_QUALITY} SELECT file_id, concat_ws(',', CASE WHEN noise > 10 THEN 'denoise_query' END, CASE WHEN "cast" > 30 THEN 'color_balance' END, CASE WHEN brightness < 80 OR brightness > 200 THEN 'brightness' END,
  CASE WHEN contrast < 30 THEN 'stretch,clahe' END, CASE WHEN blur < 100 THEN 'sharpen_strong' ELSE 'sharpen' END, CASE WHEN contrast < 30 THEN 'contrast_strong' ELSE 'contrast' END, 'color') AS steps FROM q""")  # fmt: skip
def _(spark, d):
    return measured(spark, d).select("file_id", F.concat_ws(",", images.query_steps()).alias("steps"))


@query("image_early_exit", f"{_QUALITY} SELECT file_id, blur >= 150 AND contrast >= 40 AND brightness BETWEEN 100 AND 180 AND noise < 5 AS skip FROM q")
def _(spark, d):
    return measured(spark, d).select("file_id", images.early_exit().alias("skip"))


@query("image_parameters", f"""{_QUALITY} SELECT file_id, noise > 8 AS denoise, least(15, greatest(5, CAST(trunc(noise) AS INTEGER))) AS denoise_strength, blur < 150 AS sharpen, CASE WHEN blur < 100 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS sharpen_strength,
  contrast < 40 AS enhance_contrast, CASE WHEN contrast < 30 THEN 1.5::DOUBLE ELSE 1.3::DOUBLE END AS contrast_factor, NOT (brightness BETWEEN 100 AND 180) AS adjust_brightness, 128 AS brightness_target FROM q""")  # fmt: skip
def _(spark, d):
    return measured(spark, d).select("file_id", images.adaptive_parameters().alias("p")).select("file_id", "p.*")


@query("image_asset_metrics", f"""{_PX}, hp AS (SELECT file_id, y, x, 9 * any_value(v) - sum(w) AS h, sum(w) FILTER (abs(dy) + abs(dx) = 1) - 4 * any_value(v) AS l FROM {_near(1)} GROUP BY file_id, y, x),
  c AS (SELECT *, median(h) OVER (PARTITION BY file_id) AS mid FROM hp), n AS (SELECT file_id, least(100.0::DOUBLE, var_pop(l) / 10) AS blur, median(abs(h - mid)) / 0.6745::DOUBLE AS noise FROM c GROUP BY file_id)
  SELECT file_id, round(any_value(blur), 5) AS blur, round(avg(v) / 255 * 100, 5) AS brightness, round(stddev_pop(v) / 128 * 100, 5) AS contrast, round(any_value(noise), 5) AS noise FROM px JOIN n USING (file_id) GROUP BY file_id""")  # fmt: skip
def _(spark, d):
    return images.asset_metrics(pictures(spark, d), "file_id").select("file_id", *[F.round(c, 5).alias(c) for c in ("blur", "brightness", "contrast", "noise")])


@query("image_otsu", f"""{_PX}, hist AS (SELECT file_id, v, count(*) AS n FROM px GROUP BY ALL), t AS (SELECT f.file_id, t.t, sum(coalesce(n, 0)) AS n FROM (SELECT DISTINCT file_id FROM px) f CROSS JOIN range(256) t(t) LEFT JOIN hist h ON h.file_id = f.file_id AND h.v = t.t GROUP BY ALL),
  s AS (SELECT file_id, t, CAST(sum(n) OVER w AS DOUBLE) AS w, CAST(sum(n * t) OVER w AS DOUBLE) AS m, CAST(sum(n) OVER a AS DOUBLE) AS total_w, CAST(sum(n * t) OVER a AS DOUBLE) AS total_m FROM t WINDOW w AS (PARTITION BY file_id ORDER BY t), a AS (PARTITION BY file_id)),
  b AS (SELECT file_id, t, w, CASE WHEN w > 0 AND total_w > w THEN (m * total_w - total_m * w) * (m * total_w - total_m * w) / (w * (total_w - w)) ELSE 0 END AS between_ FROM s)
  SELECT file_id, CAST(t AS INTEGER) AS threshold, CAST(w AS BIGINT) AS below FROM b QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY between_ DESC, t) = 1""")  # fmt: skip
def _(spark, d):
    return images.thresholds(pictures(spark, d), "file_id").drop("error")


def _sums(x: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, red, green, blue): sums weighted by place, so that an order of pixels shows."""
    at = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), F.lit(0).cast("long"), lambda a, i: a + (i + 1) * F.conv(F.hex(F.substring(F.col("data"), i * 3 + c + 1, F.lit(1))), 16, 10).cast("long"))
    return x.select(key, at(0).alias("red"), at(1).alias("green"), at(2).alias("blue"))


def _sql_sums(r: str, g: str, b: str, place: str = f"(y * {SIDE} + x + 1)") -> str:
    return ", ".join(f"CAST(sum({place} * ({c})) AS BIGINT) AS {n}" for c, n in ((r, "red"), (g, "green"), (b, "blue")))


@query("image_gray_world", f"{_PX}, m AS (SELECT file_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM px GROUP BY file_id) SELECT file_id, " + _sql_sums(*[f"least(255, floor({c} * ((mr + mg + mb) / 3 / m{c}) + 0.5))" for c in "rgb"]) + " FROM px JOIN m USING (file_id) GROUP BY file_id")
def _(spark, d):
    return _sums(images.apply_steps(pictures(spark, d).withColumn("steps", F.array(F.lit("color_balance"))), "file_id"))


@query("image_flip", f"{_PX} SELECT file_id, " + _sql_sums("r", "g", "b", f"(y * {SIDE} + {SIDE} - x)") + " FROM px GROUP BY file_id")
def _(spark, d):
    planned = pictures(spark, d).withColumns({"version": F.lit(0), "steps": F.array(F.lit("flip_horizontal"))})
    return _sums(augment.apply(planned, "file_id"))


@query("image_mixup", f"{_PX} SELECT p.file_id, " + ", ".join(f"CAST(sum((p.y * {SIDE} + p.x + 1) * floor(0.25::DOUBLE * p.{c} + 0.75::DOUBLE * o.{c} + 0.5)) AS BIGINT) AS {n}" for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))) + " FROM px p JOIN px o ON o.file_id = p.file_id + 1 AND o.y = p.y AND o.x = p.x GROUP BY p.file_id")
def _(spark, d):
    x = pictures(spark, d)
    other = x.select((F.col("file_id") - 1).alias("file_id"), *[F.col(c).alias(f"other_{c}") for c in ("height", "width", "data")])
    return _sums(augment.mix(x.join(other, "file_id"), "file_id", 0.25))


@query("image_cutmix")
def _(spark, d):
    x = pictures(spark, d)
    other = x.select((F.col("file_id") - 1).alias("file_id"), *[F.col(c).alias(f"other_{c}") for c in ("height", "width", "data")])
    return _sums(augment.mix(x.join(other, "file_id"), "file_id", 0.6, cut=True))


@query("image_foregrounds")
def _(spark, d):
    return images.foregrounds(pictures(spark, d), "file_id").drop("error")


@query("leaf_parameters")
def _(spark, d):
    return images.foregrounds(pictures(spark, d), "file_id").select("file_id", images.leaf_parameters().alias("p")).select("file_id", "p.*")


@query("preprocessed_images")
def _(spark, d):
    """Only pictures without early exit are worked on; the others go through as they are."""
    x = pictures(spark, d).join(images.quality(pictures(spark, d), "file_id").drop("error"), "file_id")
    done = images.apply_steps(x.filter(~images.early_exit()).withColumn("steps", images.query_steps()), "file_id").select("file_id", "data", F.lit(True).alias("worked"))
    return done.unionByName(x.filter(images.early_exit()).select("file_id", "data", F.lit(False).alias("worked"))).select("file_id", "worked", F.sha2("data", 256).alias("digest"))


@query("image_embeddings")
def _(spark, d):
    return images.embed(pictures(spark, d), "file_id").drop("error")


@query("image_hashes")
def _(spark, d):
    return images.hashes(pictures(spark, d), "file_id").drop("error")


# --- augmentation -----------------------------------------------------------------------------------------------------


def _sql_steps(profile: str) -> str:
    """(file_id, version, turn, step) drawn, from rows v of (file_id, version)."""
    table = ", ".join(f"({i}, '{s}', {p}::DOUBLE)" for i, (s, p) in enumerate(augment.PROFILES[profile].items()))
    u = "('0x' || substr(md5(concat_ws('|', v.file_id, v.version, s.step, 42)), 1, 12))::BIGINT::DOUBLE / 281474976710656"
    return f"drawn AS (SELECT v.*, s.turn, s.step FROM v CROSS JOIN (VALUES {table}) s(turn, step, p) WHERE {u} < s.p)"


for _p in augment.PROFILES:

    @query(f"augmentation_steps_{_p}", f"v AS (SELECT file_id, range AS version FROM items, range(3)), {_sql_steps(_p)} SELECT v.file_id, CAST(v.version AS INTEGER) AS version, coalesce(string_agg(step, ',' ORDER BY turn), '') AS steps FROM v LEFT JOIN drawn USING (file_id, version) GROUP BY ALL")
    def _(spark, d, p=_p):
        return augment.plan(items(spark, d).select("file_id"), "file_id", 3, p).withColumn("steps", F.concat_ws(",", "steps"))


@query("augmentation_counters", f"v AS (SELECT file_id, range AS version FROM items, range(2)), {_sql_steps('standard')} SELECT step, count(*) AS n FROM drawn GROUP BY step")
def _(spark, d):
    return augment.counters(augment.plan(items(spark, d).select("file_id"), "file_id", 2))


@query("augmentation_balance", """n AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY file_id) - 1 AS turn, count(*) OVER (PARTITION BY species) AS n FROM items),
  m AS (SELECT file_id, species, (250 - n) // n + CASE WHEN turn < (250 - n) % n THEN 1 ELSE 0 END AS mine FROM n WHERE n < 250)
  SELECT file_id, species, CAST(range AS INTEGER) AS version FROM m, range(250) WHERE range < mine""")  # fmt: skip
def _(spark, d):
    return augment.balance(items(spark, d), "file_id", "species", 250).drop("steps")


@query("augmented_images")
def _(spark, d):
    planned = augment.plan(pictures(spark, d), "file_id", 2, "aggressive")
    return augment.apply(planned, "file_id").select("file_id", "version", "applied", F.sha2("data", 256).alias("digest"))


@query("learned_parameters", """e AS (SELECT 'p' || CAST(user_id % 5 AS VARCHAR) AS param, CAST(event_id % 7 AS VARCHAR) AS value, value / 100 AS quality FROM events),
  b AS (SELECT param, value, count(*) AS n, avg(CASE WHEN quality > 0.7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM e GROUP BY ALL)
  SELECT param, CAST(sum(n) AS BIGINT) AS samples, count(*) AS tried, first(value ORDER BY rate DESC, value) FILTER (n > 5 AND rate > 0) AS best FROM b GROUP BY param""")  # fmt: skip
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("'p' || CAST(user_id % 5 AS STRING) AS param", "CAST(event_id % 7 AS STRING) AS value", "value / 100 AS quality")
    return images.learned(e)


# --- caches -----------------------------------------------------------------------------------------------------------

_REQUEST = "asked AS (SELECT event_id, 'feature:' || CAST(user_id % 100 AS VARCHAR) AS key FROM events), memo AS (SELECT 'feature:' || CAST(vec_id AS VARCHAR) AS key, label AS value, vec_id FROM embeddings)"


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "'feature:' || CAST(user_id % 100 AS STRING) AS key")
    life = "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, vec_id * 60)"
    kept = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("'feature:' || CAST(vec_id AS STRING) AS key", "label AS value", "TIMESTAMP '2024-01-01 00:00:00' AS cached_at", f"{life} AS expires_at")
    return asked, kept


_NOW = lambda: F.lit("2024-01-01 00:30:30").cast("timestamp")


@query("cache_hits", f"{_REQUEST} SELECT event_id, a.key, value FROM asked a JOIN memo m ON a.key = m.key WHERE vec_id * 60 > 1830")
def _(spark, d):
    return memo.hits(*_requests(spark, d), _NOW()).select("event_id", "key", "value")


@query("cache_misses", f"{_REQUEST} SELECT event_id, a.key FROM asked a WHERE a.key NOT IN (SELECT key FROM memo WHERE vec_id * 60 > 1830)")
def _(spark, d):
    return memo.misses(*_requests(spark, d), _NOW()).select("event_id", "key")


@query("cache_clear", f"{_REQUEST} SELECT key, value FROM memo WHERE key NOT LIKE 'feature:1%'")
def _(spark, d):
    return memo.cleared(_requests(spark, d)[1], "feature:1*").select("key", "value")


@query("cache_replay", """a AS (SELECT event_type AS cache, event_id AS turn, user_id % 60 AS key, lag(event_id) OVER (PARTITION BY event_type, user_id % 60 ORDER BY event_id) AS before FROM events),
  s AS (SELECT cache, turn, before, (SELECT count(DISTINCT b.key) FROM a b WHERE b.cache = a.cache AND b.turn > a.before AND b.turn < a.turn) AS between_ FROM a),
  c AS (SELECT cache, count(*) FILTER (before IS NOT NULL AND between_ < 20) AS hits, count(*) FILTER (before IS NULL OR between_ >= 20) AS misses FROM s GROUP BY cache)
  SELECT cache, hits, misses, greatest(misses - 20, 0) AS evictions, least(misses, 20) AS size, round(hits::DOUBLE / (hits + misses), 6) AS hit_rate FROM c""")  # fmt: skip
def _(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_type AS cache", "event_id AS at", "user_id % 60 AS key")
    return memo.replay(log, 20)


@query("number_keys", "SELECT file_id, ('0x' || substr(md5(image_path), 1, 8))::BIGINT AS number FROM items")
def _(spark, d):
    return items(spark, d).select("file_id", memo.number_key(F.md5(F.col("image_path").cast("binary"))).alias("number"))


# --- tasks, changes, sessions -----------------------------------------------------------------------------------------

_OP = "CASE event_type WHEN 'view' THEN 'submit' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'cancel' END"


def task_events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id AS task_id", "CAST(ts AS TIMESTAMP) AS ts", f"{_OP} AS op", "event_id % 50 AS processed", "50L AS total")


_TASKS = f"""e AS (SELECT user_id AS task_id, ts, {_OP} AS op, event_id % 50 AS processed FROM events),
  f AS (SELECT task_id, max(processed) AS processed, {", ".join(f"min(ts) FILTER (op = '{o}') AS {o}_at" for o in ("submit", "start", "finish", "fail", "cancel"))} FROM e GROUP BY task_id HAVING count(*) FILTER (op = 'submit') > 0),
  g AS (SELECT *, coalesce(cancel_at < coalesce(start_at, TIMESTAMP '9999-01-01'), false) AS off, CASE WHEN finish_at >= start_at THEN finish_at END AS good, CASE WHEN fail_at >= start_at THEN fail_at END AS bad FROM f),
  t AS (SELECT task_id, CASE WHEN off THEN 'cancelled' WHEN good IS NOT NULL AND (bad IS NULL OR good <= bad) THEN 'completed' WHEN bad IS NOT NULL THEN 'failed' WHEN start_at IS NOT NULL THEN 'running' ELSE 'pending' END AS status,
    CASE WHEN NOT off THEN start_at END AS started, CASE WHEN off THEN cancel_at ELSE least(good, bad) END AS ended, processed / 50.0::DOUBLE * 100 AS progress FROM g)"""


@query("task_states", f"{_TASKS} SELECT task_id, status, round(progress, 6) AS progress, round(epoch(ended) - epoch(started), 3) AS seconds FROM t")
def _(spark, d):
    return tasks.states(task_events(spark, d)).select("task_id", "status", F.round("progress", 6).alias("progress"), F.round(tasks.seconds(F.col("started"), F.col("ended"), F.lit(None)), 3).alias("seconds"))


@query("task_stats", f"{_TASKS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "running", "completed", "failed", "cancelled")) + " FROM t")
def _(spark, d):
    return tasks.statistics(tasks.states(task_events(spark, d)))


@query("feedback_sessions", """e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
  s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM e)
  SELECT user_id AS session_id, min(ts) AS began, max(ts) + INTERVAL 6 HOURS AS ended, count(*) AS events FROM s GROUP BY user_id, n""")  # fmt: skip
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id AS session_id", "CAST(ts AS TIMESTAMP) AS created_at")
    return tasks.sessions(e, "6 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "ended")})


_CHANGES = """ch0 AS (SELECT event_id AS change_id, CASE event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS operation, event_id * 3 % 900 AS file_id, CASE WHEN event_id % 2 = 0 THEN 'changed' END AS species, CASE WHEN event_id % 4 = 0 THEN 'img/new.jpg' END AS image_path FROM events),
  ch AS (SELECT * FROM ch0 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY change_id DESC) = 1),
  j AS (SELECT coalesce(i.file_id, c.file_id) AS file_id, i.file_id IS NOT NULL AS known, i.species AS o_species, i.image_path AS o_path, c.change_id, c.operation, c.species, c.image_path FROM items i FULL JOIN ch c ON i.file_id = c.file_id),
  lg AS (SELECT change_id, file_id, operation, known OR operation = 'add' AS success FROM j WHERE operation IS NOT NULL)"""


def changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS change_id", "CASE event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS operation", "event_id * 3 % 900 AS file_id", "CASE WHEN event_id % 2 = 0 THEN 'changed' END AS species", "CASE WHEN event_id % 4 = 0 THEN 'img/new.jpg' END AS image_path")
    return maintenance.apply_changes(items(spark, d), c)


@query("changed_items", f"{_CHANGES} SELECT file_id, coalesce(species, o_species) AS species, coalesce(image_path, o_path) AS image_path, NOT known OR coalesce(image_path, o_path) IS DISTINCT FROM o_path AS embed FROM j WHERE (known AND coalesce(operation, '') <> 'delete') OR (NOT known AND operation = 'add')")
def _(spark, d):
    return changed(spark, d)[0]


@query("change_log", f"{_CHANGES} SELECT * FROM lg")
def _(spark, d):
    return changed(spark, d)[1]


@query("change_stats", f"{_CHANGES} SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, " + ", ".join(f"count(*) FILTER (success AND operation = '{o}') AS {n}" for o, n in (("add", "added"), ("update", "updated"), ("delete", "deleted"))) + " FROM lg")
def _(spark, d):
    return maintenance.change_stats(changed(spark, d)[1])


@query("recent_changes", f"{_CHANGES} SELECT * FROM lg WHERE operation = 'update' ORDER BY change_id DESC LIMIT 10")
def _(spark, d):
    return maintenance.recent(changed(spark, d)[1], "update", 10)


# --- files and constraints ----------------------------------------------------------------------------------------------


@query("file_names", "SELECT file_id, 's' || substr(CAST(label AS VARCHAR), 1, 1) || '202401-' || CASE WHEN file_id < 10 THEN '0' ELSE '' END || CAST(file_id AS VARCHAR) || '-1.jpg' AS name FROM items JOIN embeddings ON vec_id = file_id")
def _(spark, d):
    name = maintenance.file_name(F.col("species"), F.lit("202401"), F.col("file_id"), F.lit(1))
    return items(spark, d).select("file_id", name.alias("name"))


@query("folder_stats", "SELECT 'species_' || CAST(label AS VARCHAR) AS folder, source, count(*) FILTER (file_id % 3 <> 1) AS images, count(*) FILTER (file_id % 3 = 1) AS segmented FROM items JOIN embeddings ON vec_id = file_id GROUP BY ALL")
def _(spark, d):
    path = F.concat_ws("/", F.lit("data"), "source", maintenance.slug(F.col("species")), F.concat(F.col("file_id").cast("string"), F.when(F.col("file_id") % 3 == 1, ".png").otherwise(".jpg")))
    return maintenance.folder_stats(items(spark, d).select(path.alias("path")), "path")


@query("next_sequences", "SELECT source AS folder, max(file_id) + 1 AS next FROM items GROUP BY source")
def _(spark, d):
    named = items(spark, d).select(F.col("source").alias("folder"), F.concat(F.lit("ab202401-"), F.col("file_id").cast("string"), F.lit("-1.jpg")).alias("name"))
    return maintenance.next_numbers(named, "folder", "name")


_LIMITS = {"position": "position >= 2", "type": "feedback_type IN ('relevant', 'irrelevant', 'clicked', 'selected')", "file": "file_id > 3"}


@query("broken_constraints", " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM feedback WHERE NOT ({c})" for n, c in _LIMITS.items()))
def _(spark, d):
    return maintenance.broken_rules(events(spark, d), "id", _LIMITS)


_NEAR = """w AS (SELECT h.*, CASE WHEN rank % 3 = 1 THEN round(2 - score, 6) END AS reranked FROM h),
  p AS (SELECT a.query_id, a.file_id, abs(a.score - b.score) AS d, b.reranked, row_number() OVER (PARTITION BY a.query_id, a.file_id ORDER BY abs(a.score - b.score), b.file_id) AS n FROM w a JOIN w b ON a.query_id = b.query_id WHERE a.reranked IS NULL AND b.reranked IS NOT NULL)"""


@query("interpolated_ranking", f"{_HITS}, {_NEAR} SELECT query_id, file_id, round(reranked, 6) AS final FROM w WHERE reranked IS NOT NULL UNION ALL SELECT query_id, file_id, round(sum(reranked / (d + 1e-8::DOUBLE)) / sum(1 / (d + 1e-8::DOUBLE)), 6) FROM p WHERE n <= 10 GROUP BY ALL")
def _(spark, d):
    found = hits(spark, d).withColumn("reranked", F.when(F.col("rank") % 3 == 1, F.round(2 - F.col("score"), 6)))
    return ranking.interpolate(found).withColumn("final", F.round("final", 6))
