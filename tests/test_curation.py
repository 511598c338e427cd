"""Operators on pictures, augmentation, caches, tasks and files, with their edge cases."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkweave.functions import pixels as P
from sparkweave.functions import vectors as V
from sparkweave.operators import augment, images, knn, maintenance, memo, ranking
from sparkweave.plans import catalog
from sparkweave.sources import io
from sparkweave.streaming import tasks

NOW = datetime(2024, 1, 1, 12)
PICTURE = "id bigint, height int, width int, data binary"


def picture(side=4, value=9):
    return side, side, bytes([value]) * (side * side * 3)


def test_bad_pictures_dont_fail_the_others(spark):
    x = spark.createDataFrame([(1, *picture()), (2, 3, 3, b"short"), (3, None, None, None), (None, *picture())], PICTURE)
    got = {r.id: r for r in images.quality(x, "id").collect()}
    assert got[1].brightness == 9 and got[1].error is None and got[None].brightness == 9
    assert got[2].brightness is None and got[2].error and got[3].error
    assert images.quality(x.filter("false"), "id").count() == 0


def test_steps_and_unknown_steps(spark):
    x = spark.createDataFrame([(1, *picture(value=20)), (2, *picture())], PICTURE).withColumn("steps", F.when(F.col("id") == 1, F.array(F.lit("brightness"))).otherwise(F.array(F.lit("nothing"))))
    got = {r.id: r for r in images.apply_steps(x, "id").collect()}
    assert bytes(got[1].data) == bytes([40]) * 48 and got[2].error == "unknown step nothing"


def test_own_extractor(spark):
    x = spark.createDataFrame([(1, *picture(value=3))], PICTURE)
    assert images.embed(x, "id", extractor=lambda p: np.array([p.mean(), 1.0])).first().v == [3.0, 1.0]


def test_images_from_files(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + bytes([1, 2, 3, 4, 5, 6]))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    row = images.read_images(spark, str(tmp_path)).first()
    assert (row.height, row.width, bytes(row.data)) == (1, 2, bytes([1, 2, 3, 4, 5, 6]))


def test_learned_parameters(spark):
    rows = [("a", "x", 0.9)] * 6 + [("a", "y", 0.9)] * 5 + [("b", "x", 0.1)] * 9
    got = {r.param: r for r in images.learned(spark.createDataFrame(rows, "param string, value string, quality double")).collect()}
    assert (got["a"].samples, got["a"].tried, got["a"].best) == (11, 2, "x") and got["b"].best is None


def test_augmentation_is_repeatable_and_balance_exact(spark):
    x = spark.createDataFrame([(i, *picture(8, i)) for i in range(6)], PICTURE)
    planned = augment.plan(x, "id", 3, "aggressive")
    once, again = [sorted(map(str, augment.apply(p, "id").collect())) for p in (planned, planned.repartition(3))]
    assert once == again and len(once) == 18
    assert augment.plan(x, "id", 0).count() == 0
    few = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "id bigint, kind string")
    got = {r.kind: r.n for r in augment.balance(few, "id", "kind", 5).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2, "b": 4}


def test_memo(spark):
    day = timedelta(days=1)
    entries = spark.createDataFrame([("a", 1, NOW - day, None), ("b", 2, NOW - day, NOW - day / 2), ("c", 3, NOW - day, NOW + day), ("c", 4, NOW - day / 2, NOW + day)], "key string, value int, cached_at timestamp, expires_at timestamp")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), (None,)], "key string")
    now = F.lit(NOW)
    assert sorted((r.key, r.value) for r in memo.hits(asked, entries, now).collect()) == [("a", 1), ("c", 4)]
    assert sorted(str(r.key) for r in memo.misses(asked, entries, now).collect()) == ["None", "b", "d", "d"]
    got, fresh = memo.through(asked.filter("key IS NOT NULL"), entries, lambda m: m.select("key", F.lit(7).alias("value")), now, 60)
    assert sorted((r.key, r.value) for r in got.collect()) == [("a", 1), ("b", 7), ("c", 4), ("d", 7), ("d", 7)]
    assert fresh.count() == 2 and fresh.first().expires_at - fresh.first().cached_at == timedelta(seconds=60)
    odd = spark.createDataFrame([("a_b:1",), ("axb:1",), ("z",)], "key string")
    assert sorted(r.key for r in memo.cleared(odd, "a_b*").collect()) == ["axb:1", "z"]


def test_replay(spark):
    log = spark.createDataFrame([("m", i, k) for i, k in enumerate("abacbaa")] + [("n", 1, "a")], "cache string, at int, key string")
    got = {r.cache: (r.hits, r.misses, r.evictions, r.size, r.hit_rate) for r in memo.replay(log, 2).collect()}
    assert got == {"m": (2, 5, 3, 2, round(2 / 7, 6)), "n": (0, 1, 0, 1, 0.0)}
    assert memo.replay(log.filter("false"), 2).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        memo.replay(log, 0)


def test_task_states(spark):
    at = lambda m: NOW + timedelta(minutes=m)
    rows = [(1, at(0), "submit"), (2, at(0), "submit"), (2, at(1), "cancel"), (2, at(2), "start"), (3, at(0), "submit"), (3, at(1), "start"), (3, at(2), "cancel"), (3, at(3), "finish"), (4, at(0), "submit"), (4, at(1), "start"), (4, at(2), "fail"), (4, at(3), "finish"), (5, at(0), "submit"), (5, at(1), "start"), (6, at(1), "start")]
    x = spark.createDataFrame([(*r, 1, 4) for r in rows], tasks.EVENT)
    got = tasks.states(x)
    assert {r.task_id: r.status for r in got.collect()} == {1: "pending", 2: "cancelled", 3: "completed", 4: "failed", 5: "running"}
    assert tasks.statistics(got).first().asDict() == {"total": 5, "pending": 1, "running": 1, "completed": 1, "failed": 1, "cancelled": 1}
    took = {r.task_id: r.s for r in got.select("task_id", tasks.seconds(F.col("started"), F.col("ended"), F.lit(at(9))).alias("s")).collect()}
    assert took == {1: None, 2: None, 3: 120, 4: 60, 5: 480}
    assert tasks.statistics(tasks.states(x.filter("false"))).first().total == 0


def test_work_is_done_once(spark, tmp_path):
    landing, log, mark = (str(tmp_path / n) for n in ("landing", "log", "mark"))
    handler = lambda t: t.selectExpr("task_id", "5L AS processed", "5L AS total", "CASE WHEN task_id = 2 THEN 'broken' END AS error")
    tasks.submit(spark, [1, 2], landing)
    tasks.work(spark, landing, log, mark, handler)
    tasks.submit(spark, [3], landing)
    tasks.work(spark, landing, log, mark, handler)
    events = spark.read.parquet(log).drop("batch")
    assert events.count() == 9
    assert {r.task_id: r.status for r in tasks.states(events).collect()} == {1: "completed", 2: "failed", 3: "completed"}


def test_changes(spark):
    x = spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2"), (3, "c", "p3")], "file_id bigint, species string, image_path string")
    c = spark.createDataFrame([(1, "update", 1, None, "p9"), (2, "update", 1, "z", None), (3, "delete", 2, None, None), (4, "delete", 8, None, None), (5, "add", 7, "n", "p7")], "change_id bigint, operation string, file_id bigint, species string, image_path string")
    after, log = maintenance.apply_changes(x, c)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "z", "p1", False), (3, "c", "p3", False), (7, "n", "p7", True)]
    assert maintenance.change_stats(log).first().asDict() == {"total": 4, "succeeded": 3, "failed": 1, "added": 1, "updated": 1, "deleted": 1}


def test_names_and_sequences(spark):
    x = spark.createDataFrame([("Acer  rubrum L. var. b x", 3), ("É-a", 120)], "s string, n int")
    assert [r[0] for r in x.select(maintenance.file_name(F.col("s"), F.lit("202402"), F.col("n"), F.lit(1))).collect()] == ["arlv202402-03-1.jpg", "é202402-120-1.jpg"]
    named = spark.createDataFrame([("f", "ab202401-07-2.jpg"), ("f", "ab202401-x-9.jpg"), ("g", "odd.jpg")], "folder string, name string")
    assert {r.folder: r.next for r in maintenance.next_numbers(named, "folder", "name").collect()} == {"f": 8, "g": 1}


def test_upload(spark):
    jpg, png = b"\xff\xd8\xff\xe0rest", b"\x89PNGrest"
    x = spark.createDataFrame([(1, "Acer rubrum", "lab", jpg), (2, "Acer rubrum", "lab", png), (3, "Acer", "field", b"GIF8"), (4, " ", "lab", jpg), (5, "Acer", "lab", None)], "upload_id bigint, species string, source string, content binary")
    known = spark.createDataFrame([("lab/acer_rubrum", "ar202401-04-1.jpg")], "folder string, name string")
    good, bad = io.upload(x, known, "202405")
    assert {r.upload_id: r.path for r in good.collect()} == {1: "lab/acer_rubrum/ar202405-05-1.jpg", 2: "lab/acer_rubrum/ar202405-06-1.png"}
    assert {r.upload_id: r.reason for r in bad.collect()} == {3: "not a picture", 4: "no species", 5: "empty"}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.jpg", "x", "lab", None, "train"), (2, "b.jpg", "y", "lab", "s.png", "val"), (3, "c.jpg", "y", "lab", None, "train")], io.SPLIT + ", split string")
    io.write_splits(rows, str(tmp_path / "s"))
    assert sorted(r.file_id for r in io.read_split(spark, str(tmp_path / "s"), "train").collect()) == [1, 3]
    io.save_model(spark, {"a": 0.5, "b": -1.0}, "linear", str(tmp_path / "m"))
    assert io.load_model(spark, str(tmp_path / "m")) == ("linear", {"a": 0.5, "b": -1.0})
    assert io.existing(rows, spark.createDataFrame([("b.jpg",)], "path string")).count() == 1


def test_interpolation(spark):
    x = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 1.0, 20.0), (1, 3, 0.5, None), (2, 4, 0.7, None)], "query_id bigint, file_id bigint, score double, reranked double")
    got = {r.file_id: round(r.final, 5) for r in ranking.interpolate(x).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 15.0, 4: 0.7}


def test_sessions(spark):
    rows = [("s", NOW + timedelta(minutes=m)) for m in (0, 10, 100)] + [("t", NOW)]
    got = tasks.sessions(spark.createDataFrame(rows, "session_id string, created_at timestamp")).collect()
    assert sorted((r.session_id, r.events) for r in got) == [("s", 1), ("s", 2), ("t", 1)]


def test_conversion_keeps_flips():
    x = np.arange(27, dtype=np.uint8).reshape(3, 3, 3)
    assert (P.AUGMENT["flip_vertical"](x, None)[0] == x[2]).all()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_cells_miss_nothing(spark, metric):
    data = "/root/testdata/sf0.001"
    corpus, asked = catalog.corpus(spark, data), catalog.asked(spark, data)
    rows = lambda df: {(r.query_id, r["rank"], r.file_id) for r in df.collect()}
    want = rows(knn.search(corpus, asked, metric))
    assert rows(knn.search_cells(*knn.build_cells(corpus), asked, metric)) == want


@pytest.mark.parametrize("metric", sorted(V.METRICS))
def test_cells_in_blocks(spark, monkeypatch, metric):
    """Groups far apart, one with most rows, copies, a zero vector, over several blocks of queries; no pair goes through
    a join or a shuffle, of which there are as many as a twentieth of the square of the rows."""
    draw = np.random.default_rng(3)
    groups = [draw.normal(5 * g, 0.1, (n, 6)) * [1, -1, 1, g, 1, 1] for g, n in enumerate((400, 40, 40, 40))]
    rows = np.round(np.concatenate([*groups, groups[0][:30], np.zeros((1, 6))]), 3).tolist()
    corpus = spark.createDataFrame(list(enumerate(rows)), "file_id long, v array<double>").repartition(5).cache()
    asked = corpus.filter("file_id % 20 = 0").withColumnRenamed("file_id", "query_id")
    by = F.col("score") if metric in V.ASCENDING else -F.col("score")
    pairs = asked.withColumnRenamed("v", "q").crossJoin(corpus).select("query_id", "file_id", F.round(V.score(metric, F.col("q"), F.col("v")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(by, "file_id"))
    want = {(r.query_id, r.place, r.file_id, r.score) for r in pairs.withColumn("place", place).filter("place <= 7").collect()}
    monkeypatch.setattr(knn, "QUERY_BLOCK", 11)
    for scores in (1 << 20, 100):
        monkeypatch.setattr(knn, "SCORES", scores, raising=False)
        found = knn.search_cells(*knn.build_cells(corpus, 6), asked, metric, 7, 1)
        assert {(r.query_id, r["rank"], r.file_id, r.score) for r in found.collect()} == want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_close_vectors_far_out(spark):
    """Distances that are small beside the vectors' lengths, by the whole scan and by cells."""
    rows = [(i, [1e4 + i * 1e-3, 1e4, -1e4]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "file_id long, v array<double>")
    asked = corpus.filter("file_id % 20 = 0").withColumnRenamed("file_id", "query_id")
    want = {(q, j, round(abs(q - j) * 1e-3, 6)) for q in (0, 20, 40) for j in sorted(range(60), key=lambda j: (abs(q - j), j))[:5]}
    for found in (knn.search(corpus, asked, "l2", 5), knn.search_cells(*knn.build_cells(corpus, 4), asked, "l2", 5, 1)):
        assert {(r.query_id, r.file_id, r.score) for r in found.collect()} == want
