"""Pictures as rows: metrics, plans of steps as columns, and the steps themselves over Arrow batches.

A picture is (height int, width int, data binary), rows of red, green and blue bytes. Metrics and plans are columns, so
that rows which need no work are filtered before any pixel is touched. A row whose data don't fit its size gives a null
result and a message in ``error``; it never fails the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import pixels as P

METRICS = ("blur", "brightness", "contrast", "noise", "edges", "cast")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, data) through Spark's decoder, whose bytes are blue, green, red, or with alpha; or grey."""
    x = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    return x.select(F.col("origin").alias("path"), "height", "width", "nChannels", "data").mapInArrow(_reordered, "path string, height int, width int, data binary")


def _reordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
            x = np.repeat(x, 3, -1) if r["nChannels"] == 1 else x[..., 2::-1]
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["height"]], pa.int32()), pa.array([r["width"]], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["path", "height", "width", "data"])


def picture(height: int | None, width: int | None, data: bytes | None) -> np.ndarray:
    if data is None or not height or not width or len(data) != height * width * 3:
        raise ValueError("not a picture: size and data differ")
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def each(images: DataFrame, key: str, work: Callable[[np.ndarray, dict], dict], schema: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, schema, error) of every picture; work gets the picture and its row of the columns in also."""
    kind = images.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        out_schema = None
        for b in batches:
            for start in range(0, b.num_rows, 32):
                part, out = b.slice(start, 32), []
                for r in part.to_pylist():
                    row = dict.fromkeys(names) | {key: r[key], "error": None}
                    try:
                        row |= work(picture(r["height"], r["width"], r["data"]), r)
                    except ValueError as e:
                        row["error"] = str(e)
                    out.append(row)
                out_schema = out_schema or pa.schema([(key, part.schema.field(key).type), *[(f.name, f.type) for f in to_arrow_schema(_arrow_of(schema))], ("error", pa.string())])
                yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    return images.select(key, "height", "width", "data", *also).mapInArrow(run, f"`{key}` {kind}, {schema}, error string")


def _arrow_of(schema: str):
    """The few types that results here have, without a session in the worker."""
    from pyspark.sql import types as T

    kinds = {"double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(), "array<double>": T.ArrayType(T.DoubleType()), "array<float>": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


def quality(images: DataFrame, key: str) -> DataFrame:
    """(key, METRICS, error)."""
    return each(images, key, lambda x, r: P.quality(x), ", ".join(f"{m} double" for m in METRICS))


def asset_metrics(images: DataFrame, key: str) -> DataFrame:
    return each(images, key, lambda x, r: P.asset_metrics(x), "blur double, brightness double, contrast double, noise double, content double")


def thresholds(images: DataFrame, key: str) -> DataFrame:
    """(key, threshold, below): Otsu's threshold and the pixels up to it."""

    def work(x: np.ndarray, r: dict) -> dict:
        t = P.otsu(g := P.grey(x))
        return {"threshold": t, "below": int((g <= t).sum())}

    return each(images, key, work, "threshold int, below bigint")


def foregrounds(images: DataFrame, key: str) -> DataFrame:
    """(key, method, share, angle, aspect, complexity, hue, texture): the chosen foreground and its shape."""

    def work(x: np.ndarray, r: dict) -> dict:
        method, mask = P.foreground(x)
        return {"method": method, "share": float(mask.mean()), "angle": P.voted_angle(mask), **P.shape(x, mask)}

    return each(images, key, work, "method string, share double, angle double, aspect double, complexity double, hue double, texture double")


def apply_steps(images: DataFrame, key: str, steps: str = "steps") -> DataFrame:
    """(key, height, width, data) after the steps that the column names, in order; an unknown step is an error."""

    def work(x: np.ndarray, r: dict) -> dict:
        for s in r[steps] or ():
            if s not in P.STEPS:
                raise ValueError(f"unknown step {s}")
            x = P.STEPS[s](x)
        return {"height": x.shape[0], "width": x.shape[1], "data": x.tobytes()}

    renamed = images.withColumnRenamed("error", "earlier_error") if "error" in images.columns else images
    return each(renamed, key, work, "height int, width int, data binary", (steps,))


def embed(images: DataFrame, key: str, dimension: int = 64, extractor: Callable[[np.ndarray], np.ndarray] | None = None, most: int = 512) -> DataFrame:
    """(key, v): vectors from the extractor given, or from a fixed random projection."""
    take = extractor or (lambda x: P.project(x, dimension))
    return each(images, key, lambda x, r: {"v": [float(e) for e in take(P.resize_within(x, most))]}, "v array<float>")


def hashes(images: DataFrame, key: str) -> DataFrame:
    """(key, perceptual, thumbnail): perceptual is equal or near for pictures that look alike, compare by bit_count(a ^ b);
    thumbnail is equal for pictures with the same pixels at 64 x 64, and a key for what is computed from them."""
    return each(images, key, lambda x, r: {"perceptual": P.perceptual_hash(x), "thumbnail": P.thumbnail_hash(x)}, "perceptual bigint, thumbnail string")


# --- plans: columns over the metrics ----------------------------------------------------------------------------------


def _steps(*parts: tuple[Column | None, str]) -> Column:
    return F.array_compact(F.array(*[F.lit(s) if w is None else F.when(w, F.lit(s)) for w, s in parts]))


def flags() -> dict[str, Column]:
    c = F.col
    return {"blurry": c("blur") < 100, "dark": c("brightness") < 80, "bright": c("brightness") > 200, "low_contrast": c("contrast") < 30, "noisy": c("noise") > 10, "cast_off": c("cast") > 30}


def catalogue_steps() -> Column:
    """Steps for a picture of the catalogue."""
    f = flags()
    return _steps((F.col("blur") < 150, "denoise"), (f["dark"] | f["bright"], "color_balance"), (f["low_contrast"], "clahe"))


def query_steps() -> Column:
    """Steps for a picture that is searched with."""
    f = flags()
    low = f["low_contrast"]
    return _steps((f["noisy"], "denoise_query"), (f["cast_off"], "color_balance"), (f["dark"] | f["bright"], "brightness"), (low, "stretch"), (low, "clahe"), (f["blurry"], "sharpen_strong"), (~f["blurry"], "sharpen"), (low, "contrast_strong"), (~low, "contrast"), (None, "color"))


def early_exit(blur: float = 150, contrast: float = 40, low: float = 100, high: float = 180, noise: float = 5) -> Column:
    c = F.col
    return (c("blur") >= blur) & (c("contrast") >= contrast) & c("brightness").between(low, high) & (c("noise") < noise)


def adaptive_parameters() -> Column:
    c = F.col
    return F.struct(
        (c("noise") > 8).alias("denoise"), F.least(F.lit(15), F.greatest(F.lit(5), c("noise").cast("int"))).alias("denoise_strength"),
        (c("blur") < 150).alias("sharpen"), F.when(c("blur") < 100, 2.0).otherwise(1.5).alias("sharpen_strength"),
        (c("contrast") < 40).alias("enhance_contrast"), F.when(c("contrast") < 30, 1.5).otherwise(1.3).alias("contrast_factor"),
        (~c("brightness").between(100, 180)).alias("adjust_brightness"), F.lit(128).alias("brightness_target"),
    )


def leaf_parameters() -> Column:
    """From complexity, texture and aspect of foregrounds()."""
    c = F.col("complexity")
    kind = F.when(c > 3, "lobed").when(c > 2, "serrated").otherwise("smooth")
    edge, smooth = F.when(c > 3, 1.8).when(c > 2, 1.5).otherwise(1.2), F.when(c > 3, 0.5).when(c > 2, 0.7).otherwise(1.0)
    return F.struct(kind.alias("leaf_type"), edge.alias("edge_enhancement"), smooth.alias("smoothing_strength"), F.when(F.col("texture") > 0.7, 5).otherwise(10).alias("denoise_strength"), (F.col("aspect") > 2).alias("rotation_sensitive"))


def profile() -> Column:
    """lab: few edges and even colours; else field."""
    return F.when((F.col("edges") < 0.15) & (F.col("contrast") < 50), "lab").otherwise("field")


def learned(events: DataFrame, least: int = 5) -> DataFrame:
    """(param, samples, tried, best) of (param, value, quality): success above .7; best of the values with more than
    ``least`` samples, ties to the least value; null where no value has as many."""
    by = events.groupBy("param", "value").agg(F.count("*").alias("n"), F.avg(F.when(F.col("quality") > 0.7, 1.0).otherwise(0.0)).alias("rate"))
    known = F.when((F.col("n") > least) & (F.col("rate") > 0), F.struct((-F.col("rate")).alias("r"), F.col("value").alias("v")))
    return by.groupBy("param").agg(F.sum("n").alias("samples"), F.count("*").alias("tried"), F.min(known)["v"].alias("best"))
