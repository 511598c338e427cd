"""Indexing tasks as an event log: states, statistics, and a stream that works what is pending.

An event is (task_id, ts, op, processed, total): submit, start, progress, finish, fail or cancel. A task can be cancelled
only before it starts; the first end after a start counts, and what comes later changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "task_id bigint, ts timestamp, op string, processed bigint, total bigint"


def _first(op: str) -> Column:
    return F.min(F.when(F.col("op") == op, F.col("ts"))).alias(op)


def states(events: DataFrame) -> DataFrame:
    """(task_id, status, started, ended, progress): one row for each task that was submitted."""
    by = events.groupBy("task_id").agg(*[_first(o) for o in ("submit", "start", "finish", "fail", "cancel")], F.max("processed").alias("processed"), F.max("total").alias("total")).filter("submit IS NOT NULL")
    cancelled = F.col("cancel").isNotNull() & (F.col("start").isNull() | (F.col("cancel") < F.col("start")))
    finish, fail = [F.when(F.col(o) >= F.col("start"), F.col(o)) for o in ("finish", "fail")]
    status = F.when(cancelled, "cancelled").when(finish.isNotNull() & (fail.isNull() | (finish <= fail)), "completed").when(fail.isNotNull(), "failed").when(F.col("start").isNotNull(), "running").otherwise("pending")
    progress = F.coalesce(F.try_divide(F.col("processed"), F.col("total")), F.lit(0.0)) * 100
    return by.select("task_id", status.alias("status"), F.when(~cancelled, F.col("start")).alias("started"), F.when(cancelled, F.col("cancel")).otherwise(F.least(finish, fail)).alias("ended"), progress.alias("progress"))


def seconds(started: Column, ended: Column, now: Column) -> Column:
    """Of a task's run so far; null before it starts."""
    return (F.unix_micros(F.coalesce(ended, now).cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6


def statistics(tasks: DataFrame) -> DataFrame:
    """(total, pending, running, completed, failed, cancelled)."""
    return tasks.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "completed", "failed", "cancelled")])


def throughput(runs: DataFrame, error: str, took: Column) -> DataFrame:
    """(succeeded, failed, per_second) of rows with an error column and seconds."""
    good = F.count_if(F.col(error).isNull())
    return runs.agg(good.alias("succeeded"), F.count_if(F.col(error).isNotNull()).alias("failed"), F.coalesce(F.try_divide(F.count("*"), F.max(took)), F.lit(0.0)).alias("per_second"))


def submit(spark: SparkSession, ids: list[int], path: str) -> None:
    """Tasks into the landing folder that work() reads."""
    spark.createDataFrame([(i,) for i in ids], "task_id bigint").selectExpr("task_id", "current_timestamp() AS ts", "'submit' AS op", "0L AS processed", "0L AS total").write.mode("append").parquet(path)


def work(spark: SparkSession, landing: str, log: str, checkpoint: str, handler: Callable[[DataFrame], DataFrame]) -> None:
    """Run what is pending, in micro-batches, until the landing folder is worked off.

    handler: tasks to (task_id, processed, total, error). A batch's events overwrite its own folder, so a batch that is
    run again after a failure leaves no second copy.
    """

    def batch(tasks: DataFrame, number: int) -> None:
        asked = tasks.filter("op = 'submit'").select("task_id", "ts").join(tasks.filter("op = 'cancel'").select("task_id"), "task_id", "left_anti")
        done = handler(asked.select("task_id")).selectExpr("task_id", "current_timestamp() AS ts", "CASE WHEN error IS NULL THEN 'finish' ELSE 'fail' END AS op", "processed", "total")
        begun = asked.selectExpr("task_id", "current_timestamp() AS ts", "'start' AS op", "0L AS processed", "0L AS total")
        tasks.unionByName(begun).unionByName(done).write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = spark.readStream.schema(EVENT).parquet(landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def new_contents(uploads: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of uploads (content, ts) without exact copies within the bound."""
    return uploads.withColumn("hash", F.md5("content")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(session_id, began, ended, events): feedback in sessions that end after a gap; the same on streams and tables."""
    seen = events.withWatermark("created_at", late) if events.isStreaming else events
    by = seen.groupBy("session_id", F.session_window("created_at", gap).alias("w")).agg(F.count("*").alias("events"))
    return by.select("session_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")
