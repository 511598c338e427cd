"""Metadata files, listings and the vector index's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "file_id bigint, image_path string, segmented_path string, species string, source string"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header; blank and ``nan`` segmented paths are null."""
    rows = spark.read.option("sep", "\t").option("header", True).schema(METADATA).csv(path)
    return rows.withColumn("segmented_path", F.nullif(F.nullif(F.trim("segmented_path"), F.lit("")), F.lit("nan")))


def profile(rows: DataFrame) -> DataFrame:
    """(total, species, lab, field, segmented) of metadata, in one pass."""
    c = F.col
    return rows.agg(F.count("*").alias("total"), F.count_distinct("species").alias("species"), F.count_if(c("source") == "lab").alias("lab"), F.count_if(c("source") == "field").alias("field"), F.count("segmented_path").alias("segmented"))


def new_rows(rows: DataFrame, known: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows whose key isn't known yet, each once: loading twice changes nothing."""
    return rows.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, modified) of the files below path, without their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def written(files: DataFrame, expected: int) -> DataFrame:
    """(files, bytes, percent) of a listing, against the bytes that are expected at the end; 0 percent if that is 0."""
    found = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return found.withColumn("percent", F.coalesce(F.try_divide(F.col("bytes") * 100, F.lit(expected)), F.lit(0.0)))


def save_index(index: DataFrame, path: str, metric: str) -> None:
    """(file_id, v) with the metric in every row's partition, so that no file beside the table is needed."""
    index.withColumn("metric", F.lit(metric)).write.mode("overwrite").partitionBy("metric").parquet(path)


def load_index(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """The index, which must have been saved for this metric."""
    rows = spark.read.parquet(path)
    if rows.filter(F.col("metric") == metric).isEmpty():
        raise ValueError(f"the index isn't one for {metric}")
    return rows.filter(F.col("metric") == metric).drop("metric")


SPLIT = "file_id bigint, image_path string, species string, source string, segmented_path string"


def write_splits(rows: DataFrame, path: str) -> None:
    """(SPLIT columns, split) as one folder of CSV files a split, ``split=train`` and so on, by one pass over the rows."""
    kept = rows.filter(F.col("split").isin("train", "val", "test")).select(*[c.split()[0] for c in SPLIT.split(", ")], "split")
    kept.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("header", True).schema(SPLIT).csv(f"{path}/split={name}")


def save_model(spark: SparkSession, weights: dict[str, float], algorithm: str, path: str) -> None:
    spark.createDataFrame([(algorithm, weights)], "algorithm string, weights map<string, double>").coalesce(1).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str) -> tuple[str, dict[str, float]]:
    row = spark.read.schema("algorithm string, weights map<string, double>").json(path).first()
    if row is None:
        raise ValueError("no model there")
    return row.algorithm, dict(row.weights)


def write_report(metrics: DataFrame, path: str) -> None:
    """One row of metrics as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def existing(rows: DataFrame, files: DataFrame, path: str = "image_path") -> DataFrame:
    """Rows whose file is in the listing."""
    return rows.join(files.select(F.col("path").alias(path)), path, "left_semi")


#: First bytes of the formats that are taken.
MAGIC = {"JPEG": "FFD8FF", "PNG": "89504E47"}


def upload(files: DataFrame, known: DataFrame, month: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) of uploads (upload_id, species, source, content).

    known: (folder, name) of the files there are. An accepted row has its path: the next sequence of its species and
    source, in order of upload_id. What is neither JPEG nor PNG is quarantined with a reason.
    """
    from pyspark.sql import Window

    from sparkweave.operators import maintenance as M

    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head.startswith(MAGIC["JPEG"]), "jpg").when(head == MAGIC["PNG"], "png")
    x = files.withColumn("extension", kind).withColumn("folder", F.concat_ws("/", "source", M.slug(F.col("species"))))
    reason = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty").when(F.col("extension").isNull(), "not a picture").when(M.slug(F.coalesce("species", F.lit(""))) == "", "no species")
    x = x.withColumn("reason", reason)
    good = x.filter("reason IS NULL").join(M.next_numbers(known, "folder", "name"), "folder", "left")
    place = F.row_number().over(Window.partitionBy("folder").orderBy("upload_id"))
    sequence = F.coalesce("next", F.lit(1)) + place - 1
    name = M.file_name(F.col("species"), F.lit(month), sequence, F.lit(1), "")
    return good.select("upload_id", F.concat(F.col("folder"), F.lit("/"), name, F.col("extension")).alias("path"), "content"), x.filter("reason IS NOT NULL").select("upload_id", "reason")
