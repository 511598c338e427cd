"""Feedback analytics: rates, graded relevance, judgments and query refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions import vectors as V

#: Grade of each kind of feedback.
GRADES = {"relevant": 2.0, "selected": 1.5, "clicked": 0.5, "irrelevant": -1.0, "dismissed": -0.5}
ROCCHIO = (1.0, 0.75, 0.15)


def grade(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, g in GRADES.items():
        out = F.when(kind == name, g).otherwise(out)
    return out


def file_stats(feedback: DataFrame) -> DataFrame:
    """(file_id, events, ctr, conversion, avg_position)."""
    share = lambda *kinds: F.round(F.avg(F.when(F.col("feedback_type").isin(*kinds), 1.0).otherwise(0.0)), 6)
    return feedback.groupBy("file_id").agg(F.count("*").alias("events"), share("clicked", "selected").alias("ctr"), share("selected").alias("conversion"), F.round(F.coalesce(F.avg("position"), F.lit(0.0)), 6).alias("avg_position"))


def labels(feedback: DataFrame) -> DataFrame:
    """(file_id, label): the mean grade of an item's feedback plus 1, at least 0, for learning to rank."""
    return feedback.groupBy("file_id").agg(F.greatest(F.lit(0.0), F.avg(grade(F.col("feedback_type"))) + 1).alias("label"))


def judgments(feedback: DataFrame) -> DataFrame:
    """(query_hash, file_id, judged): relevant for relevant and selected, irrelevant for irrelevant and dismissed; clicks don't count."""
    judged = F.when(F.col("feedback_type").isin("relevant", "selected"), "relevant").when(F.col("feedback_type").isin("irrelevant", "dismissed"), "irrelevant")
    return feedback.withColumn("judged", judged).filter("judged IS NOT NULL").select("query_hash", "file_id", "judged")


def graded_relevance(feedback: DataFrame, queries: int | None = None) -> DataFrame:
    """(query_hash, file_id, relevance, place): summed grades, files in order of their first position; of all queries, or
    of as many as were asked first (by id)."""
    if queries is not None:
        first = feedback.groupBy("query_hash").agg(F.min("id").alias("first")).orderBy("first", "query_hash").limit(queries)
        feedback = feedback.join(F.broadcast(first.select("query_hash")), "query_hash", "left_semi") if queries <= 10_000 else feedback.join(first.select("query_hash"), "query_hash", "left_semi")
    by = feedback.groupBy("query_hash", "file_id").agg(F.sum(grade(F.col("feedback_type"))).alias("relevance"), F.min("position").alias("first"))
    place = F.row_number().over(Window.partitionBy("query_hash").orderBy("first", "file_id"))
    return by.select("query_hash", "file_id", "relevance", place.cast("long").alias("place"))


def refine(queries: DataFrame, judged: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rocchio: (query_id, i, x) of the refined unit vectors, one row for each element; unchanged without judgments.

    queries: (query_id, v); judged: (query_id, file_id, judged); corpus: (file_id, v).
    """
    a, b, c = ROCCHIO
    parts = judged.join(corpus, "file_id").select("query_id", "judged", F.posexplode(V.dbl(F.col("v"))).alias("i", "x"))
    means = parts.groupBy("query_id", "i").agg(F.avg(F.when(F.col("judged") == "relevant", F.col("x"))).alias("good"), F.avg(F.when(F.col("judged") == "irrelevant", F.col("x"))).alias("bad"))
    own = queries.select("query_id", F.posexplode(V.dbl(F.col("v"))).alias("i", "x"))
    seen = means.select("query_id").distinct().withColumn("seen", F.lit(True))
    moved = own.join(means, ["query_id", "i"], "left").join(seen, "query_id", "left")
    moved = moved.withColumn("y", a * F.col("x") + b * F.coalesce("good", F.lit(0.0)) - c * F.coalesce("bad", F.lit(0.0)))
    length = F.sqrt(F.sum(F.col("y") * F.col("y")).over(Window.partitionBy("query_id")))
    return moved.select("query_id", F.col("i").cast("long").alias("i"), F.round(F.when(F.col("seen") & (length > 0), F.col("y") / length).otherwise(F.col("x")), 6).alias("x"))
