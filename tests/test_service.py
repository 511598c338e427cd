import random

import pytest
from pyspark.sql import functions as F

from sparkweave.functions import vectors as V
from sparkweave.operators import augment, explain, feedback, maintenance, quality, ranking


def test_copies_over_ranges(spark):
    """One content in two thirds of the rows, over many ranges of keys, against a loop over all rows."""
    draw = random.Random(1)
    rows = [(k, None if k % 11 == 0 else "hot" if k % 3 else str(k % 7), draw.random() < 0.5) for k in draw.sample(range(-50, 400), 300)]
    got = quality.valid_duplicates(spark.createDataFrame(rows, "k long, c string, ok boolean"), "k", F.col("c"), F.col("ok"), width=16)
    last, want = {}, set()
    for k, c, ok in sorted(rows):
        if c is not None and c in last:
            want.add((k, last[c]))
        if c is not None and ok:
            last[c] = k
    assert {tuple(r) for r in got.collect()} == want


def test_copies_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (None, "x"), (3, "x"), (4, "x"), (5, "")], "k long, c string")
    assert [tuple(r) for r in quality.duplicates(rows, "k", F.col("c")).collect()] == [(4, 3)]
    assert quality.duplicates(rows.limit(0), "k", F.col("c")).collect() == []


def test_split_of_hot_stratum(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(400)] + [(1000 + i, None) for i in range(40)], "k long, s string")
    split = maintenance.stratified_split(rows, "k", "s")
    sizes = {(r.s, r.split): r["count"] for r in split.groupBy("s", "split").count().collect()}
    for s, n in (("a", 360), ("b", 40), (None, 40)):
        first, second = int(n * 0.7), int(n * (0.7 + 0.15))
        assert [sizes[s, p] for p in ("train", "val", "test")] == [first, second - first, n - second]
    assert {(r.k, r.split) for r in split.collect()} == {(r.k, r.split) for r in maintenance.stratified_split(rows.repartition(3), "k", "s").collect()}
    assert maintenance.stratified_split(rows.limit(0), "k", "s").collect() == []


def test_labels(spark):
    e = spark.createDataFrame([(1, "relevant"), (1, "clicked"), (2, "irrelevant"), (3, "dismissed"), (3, "irrelevant")], "file_id long, feedback_type string")
    assert {r.file_id: r.label for r in feedback.labels(e).collect()} == {1: 2.25, 2: 0.0, 3: 0.25}


def test_quantiles(spark):
    x = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([5.0],), ([],)], "v array<double>")
    assert [r.q for r in x.select(V.quantile(F.col("v"), 0.25).alias("q")).collect()] == [1.75, 5.0, None]


def test_statistics_of_nothing(spark):
    issue = "array<struct<rule string, severity string>>"
    got = quality.statistics(spark.createDataFrame([], f"k long, c string, issues {issue}"), "k", "issues", F.col("c")).first()
    assert (got.total, got.valid, got.issues, got.duplicates, got.rate) == (0, 0, 0, 0, 0.0)
    planned = spark.createDataFrame([(["b", "a"],), (["b"],), ([],)], "steps array<string>")
    assert tuple(augment.summary(planned).first()) == (3, 2, "b")
    assert tuple(augment.summary(planned.limit(0)).first()) == (0, 0, None)


def test_sources_without_hits(spark):
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 9.0]), (3, [1.0, 1.0])], "query_id long, v array<double>")
    hits = spark.createDataFrame([(3, 1, "lab"), (3, 2, "lab"), (3, 6, "field")], "query_id long, rank long, source string")
    assert {r.query_id: r.preferred for r in ranking.preferred_sources(hits, queries).collect()} == {1: "field", 2: "lab", 3: "lab"}


def test_training_run(spark):
    weights = {"a": 0.0, "b": 0.0}
    rows = spark.createDataFrame([(q, f, f * 1.0, f * 1.0, 1.0) for q in range(20) for f in range(4)], "query_id long, file_id long, label double, a double, b double")
    learned, tested = ranking.run_training(rows, 3, weights)
    assert learned["a"] > 0 and tested.count() == 3 and {r.ndcg for r in tested.collect()} == {1.0}
    best = ranking.search_by_model(rows, learned, 1).collect()
    assert {(r.file_id, r.place) for r in best} == {(3, 1)}
    with pytest.raises(ValueError, match="no queries to"):
        ranking.run_training(rows.filter("query_id = 0"), 1, weights)


def test_training_run_of_equal_labels(spark):
    """Test queries without any feedback, as on larger tables."""
    rows = spark.createDataFrame([(q, f, 0.0, f * 1.0, 1.0) for q in range(20) for f in range(4)], "query_id long, file_id long, label double, a double, b double")
    tested = ranking.run_training(rows, 2, {"a": 0.1, "b": 0.0})[1].collect()
    assert len(tested) == 3 and {(r.n, r.ndcg, str(r.spearman)) for r in tested} == {(4, 0.0, "nan")}


def test_evaluation_of_equal_labels(spark):
    """A rank correlation isn't defined where all labels or scores are equal, or with one row: NaN, as in SQL."""
    lists = {1: [(2.0, 0.3), (1.0, 0.2), (0.0, 0.1)], 2: [(0.0, 0.3), (0.0, 0.2)], 3: [(1.0, 0.5), (0.0, 0.5)], 4: [(1.0, 1.0)], 5: [(0.0, 0.3), (1.0, 0.2)]}
    rows = spark.createDataFrame([(q, f, y, s) for q, x in lists.items() for f, (y, s) in enumerate(x)], "query_id long, file_id long, label double, score double")
    got = {r.query_id: r for r in ranking.evaluate(rows).collect()}
    assert {q: str(r.spearman) for q, r in got.items()} == {1: "1.0", 2: "nan", 3: "nan", 4: "nan", 5: "-1.0"}
    assert (got[2].n, got[2].mse, got[2].mae, got[2].ndcg) == (2, 0.065, 0.25, 0.0)


def test_ingest(spark):
    known = spark.createDataFrame([(1, "x")], "file_id long, species string")
    index = spark.createDataFrame([(1, [1.0], 0)], "file_id long, v array<double>, slot long")
    new = spark.createDataFrame([(1, "changed"), (2, "y"), (3, "z"), (3, "z"), (4, "no vector")], "file_id long, species string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "file_id long, v array<double>")
    of = lambda *a, **k: [sorted(map(tuple, x.collect())) for x in maintenance.ingest(new, vectors, known, index, "file_id", *a, **k)]
    items, slots, counts = of()
    assert items == [(1, "x"), (2, "y"), (3, "z")] and [(r[0], r[2]) for r in slots] == [(1, 0), (2, 1), (3, 2)] and counts == [(4, 1, 1, 2, 3)]
    assert of(skip_known=False)[0] == [(1, "changed"), (2, "y"), (3, "z")]
    items, slots, counts = of(reset=True, limit=2)
    assert items == [(1, "changed"), (2, "y")] and [(r[0], r[2]) for r in slots] == [(1, 0), (2, 1)] and counts == [(2, 0, 0, 2, 2)]


def test_report_of_raw_index(spark):
    raw = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "file_id long, v array<double>")
    got = maintenance.index_report(raw, F.abs(V.norm(F.col("v")) - 1) < 0.001, {"cosine": True, "l1": False})
    assert {(r.metric, r.vectors, r.dimensions, r.units, r.fits) for r in got.collect()} == {("cosine", 2, 2, 1, False), ("l1", 2, 2, 1, True)}


def test_json_of_fractions(spark):
    row = spark.range(1).select(explain.as_json({"a": F.lit(0.123456), "b": F.lit("x")}, ("a",)).alias("j")).first()
    assert row.j == '{"a":0.1235,"b":"x"}'
