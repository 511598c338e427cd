"""Augmentation: the plan (which steps on which version of which row) is relational; only the kernels touch pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions import pixels as P
from sparkweave.operators.images import each, picture
from sparkweave.operators.maintenance import hash_order

#: The profiles' steps with their probabilities.
PROFILES = {
    "minimal": {"rotation": 0.5, "flip_horizontal": 0.5, "brightness": 0.3},
    "standard": {"rotation": 0.6, "flip_horizontal": 0.5, "scale": 0.3, "brightness": 0.4, "contrast": 0.4, "saturation": 0.3, "gaussian_noise": 0.2, "gaussian_blur": 0.2},
    "aggressive": {"rotation": 0.7, "flip_horizontal": 0.5, "flip_vertical": 0.3, "scale": 0.5, "brightness": 0.6, "contrast": 0.6, "saturation": 0.4, "hue": 0.3, "gaussian_noise": 0.3, "gaussian_blur": 0.2, "cutout": 0.3, "perspective": 0.3, "elastic": 0.2},
}


def uniform(*cols: Column) -> Column:
    """In [0, 1), from the first 48 bits of a digest."""
    return F.conv(F.substring(hash_order(*cols), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def steps(key: Column, version: Column, profile: str = "standard", seed: int = 42) -> Column:
    """The steps drawn for a version of a row, in the profile's order."""
    drawn = [F.when(uniform(key, version, F.lit(s), F.lit(seed)) < p, F.lit(s)) for s, p in PROFILES[profile].items()]
    return F.array_compact(F.array(*drawn))


def plan(items: DataFrame, key: str, versions: int, profile: str = "standard", seed: int = 42) -> DataFrame:
    """(items, version, steps): each row as often as versions says, from 0."""
    each_version = items.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(versions - 1)))) if versions > 0 else items.withColumn("version", F.lit(0)).filter("false")
    return each_version.withColumn("steps", steps(F.col(key), F.col("version"), profile, seed))


def balance(items: DataFrame, key: str, stratum: str, target: int, profile: str = "standard", seed: int = 42) -> DataFrame:
    """(key, stratum, version, steps): new versions that bring each stratum to the target exactly.

    Rows are dealt in rounds, by key: what a row gets follows from its place, so that nothing is made and thrown away.
    Only strata below the target are put in order, so a window holds fewer rows than the target.
    """
    sized = items.groupBy(stratum).agg(F.count("*").alias("n")).filter(F.col("n") < target)
    short = items.join(sized, stratum).select(key, stratum, "n", (F.row_number().over(Window.partitionBy(stratum).orderBy(key)) - 1).alias("at"))
    need = F.lit(target) - F.col("n")
    mine = F.floor(need / F.col("n")) + F.when(F.col("at") < need % F.col("n"), 1).otherwise(0)
    rows = short.withColumn("mine", mine.cast("int")).filter("mine > 0").withColumn("version", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)))
    return rows.select(key, stratum, "version", steps(F.col(key), F.col("version"), profile, seed).alias("steps"))


def apply(images: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(key, version, applied, height, width, data) of (key, version, steps, height, width, data); draws depend on key, version and seed."""

    def work(x: np.ndarray, r: dict) -> dict:
        rng = np.random.Generator(np.random.PCG64([seed, int.from_bytes(str(r[key]).encode(), "big"), r["version"]]))
        for s in r["steps"] or ():
            x = P.AUGMENT[s](x, rng)
        return {"version": r["version"], "applied": ",".join(r["steps"] or ()), "height": x.shape[0], "width": x.shape[1], "data": np.ascontiguousarray(x).tobytes()}

    return each(images.withColumn("version", F.col("version").cast("int")), key, work, "version int, applied string, height int, width int, data binary", ("version", "steps"))


def mix(pairs: DataFrame, key: str, share: float = 0.5, cut: bool = False, seed: int = 42) -> DataFrame:
    """(key, height, width, data): each picture blended with, or partly covered by, the one in other_height, other_width, other_data."""

    def work(x: np.ndarray, r: dict) -> dict:
        y = picture(r["other_height"], r["other_width"], r["other_data"])
        out = P.cutmix(x, y, share, np.random.Generator(np.random.PCG64(seed))) if cut else P.mixup(x, y, share)
        return {"height": out.shape[0], "width": out.shape[1], "data": out.tobytes()}

    return each(pairs, key, work, "height int, width int, data binary", ("other_height", "other_width", "other_data"))


def counters(planned: DataFrame) -> DataFrame:
    """(step, n) of all steps planned."""
    return planned.select(F.explode("steps").alias("step")).groupBy("step").agg(F.count("*").alias("n"))


def summary(planned: DataFrame) -> DataFrame:
    """(total, kinds, most) of all steps planned: how many, of how many kinds, and the most frequent (ties: the first name)."""
    return counters(planned).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds"), F.min_by("step", F.struct(-F.col("n"), "step")).alias("most"))
