"""What the operators share: table access, tables in the shared folder, hashing and column helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A word is a run of characters other than blanks: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of our own only where it is unset and all is one
    machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkweave-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()  # shuffle files of finished jobs go when the driver's references to them do
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a table of stage_table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """A-Z only, so that results don't depend on a locale."""
    return F.translate(c, UPPER, LOWER)


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores after it until no column of taken is called so (in any case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def keyed_hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def row_hash(df: DataFrame) -> Column:
    """Of all columns that can be hashed: the tie-break between rows with equal keys."""
    cols = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*cols)


def text_size_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def size_in_bytes(df: DataFrame, text: str) -> int:
    """Of df's files, by the plan's statistics; where the plan can't tell, of the column text, by a scan."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 60 else int(df.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0)


def schema_of(**kinds: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in kinds.items()))
