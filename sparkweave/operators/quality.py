"""Asset validation: rules as columns, duplicates by content hash, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits and penalties.
LEAST_BYTES, MOST_BYTES, LEAST_SIDE, MOST_SIDE, LEAST_SCORE = 1024, 10 * 1024 * 1024, 224, 4096, 50
PENALTIES = {"critical": 50, "error": 20, "warning": 5, "info": 1}


def issues(size: Column, width: Column, height: Column, intensity: Column, species: Column) -> Column:
    """array<struct<rule, severity>> of one asset."""

    def rule(name: str, severity: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))

    aspect = width / F.nullif(height, F.lit(0))
    found = [
        rule("missing", "critical", size.isNull()), rule("too_small", "error", size < LEAST_BYTES), rule("too_large", "warning", size > MOST_BYTES),
        rule("low_resolution", "error", F.least(width, height) < LEAST_SIDE), rule("high_resolution", "warning", F.greatest(width, height) > MOST_SIDE),
        rule("aspect", "warning", (aspect < 0.5) | (aspect > 2)), rule("blank", "error", (intensity < 5) | (intensity > 250)),
        rule("no_species", "error", F.trim(F.coalesce(species, F.lit(""))) == ""), rule("short_species", "warning", F.length(F.trim(species)).between(1, 2)),
    ]
    return F.array_compact(F.array(*found))


def count_of(found: Column, severity: str) -> Column:
    return F.size(F.filter(found, lambda x: x["severity"] == severity))


def score(found: Column) -> Column:
    lost = sum((count_of(found, s) * p for s, p in PENALTIES.items()), F.lit(0))
    return F.greatest(F.lit(0), F.lit(100) - lost)


def valid(found: Column) -> Column:
    return (score(found) >= LEAST_SCORE) & (count_of(found, "critical") == 0)


def acceptable(found: Column) -> Column:
    return (count_of(found, "critical") == 0) & (count_of(found, "error") == 0)


def duplicates(items: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, holder): rows whose content an earlier row has; holder is the latest of those. Null contents are no copies."""
    return valid_duplicates(items, key, content, F.lit(True))


def statistics(items: DataFrame, key: str, found: str, content: Column) -> DataFrame:
    """(total, valid, acceptable, rate, mean_score, issues, duplicates) of items with their issues; rate in percent."""
    x = F.col(found)
    n = items.agg(F.count("*").alias("total"), F.count_if(valid(x)).alias("valid"), F.count_if(acceptable(x)).alias("acceptable"), F.round(F.avg(score(x)), 6).alias("mean_score"), F.coalesce(F.sum(F.size(x)), F.lit(0)).alias("issues"))
    copies = valid_duplicates(items, key, content, valid(x)).agg(F.count("*").alias("duplicates"))
    return n.crossJoin(copies).withColumn("rate", F.coalesce(F.round(F.try_divide(F.col("valid") * 100.0, F.col("total")), 6), F.lit(0.0)))  # one row each


#: Formats, limits of the picture metrics, and penalties beside those by severity.
FORMATS = ("JPEG", "PNG", "JPG")
LEAST_BLUR, LEAST_BRIGHT, MOST_BRIGHT, LEAST_CONTRAST = 20, 20, 80, 15
VERY_BLURRED, LEAST_CONTENT, BLUR_PENALTY, CONTENT_PENALTY = 30, 40, 10, 15


def picture_issues(format_: Column, blur: Column, brightness: Column, contrast: Column) -> Column:
    """array<struct<rule, severity>> of what the picture itself shows; metrics in percent."""
    rules = {"format": ("error", ~F.upper(format_).isin(*FORMATS)), "blurred": ("warning", blur < LEAST_BLUR), "dark": ("warning", brightness < LEAST_BRIGHT), "bright": ("warning", brightness > MOST_BRIGHT), "flat": ("warning", contrast < LEAST_CONTRAST)}
    return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (s, when) in rules.items()]))


def full_score(found: Column, size: Column, blur: Column, content: Column) -> Column:
    """0 to 100: penalties by severity, and for blur and content; an asset without a file scores 0."""
    lost = F.when(blur < VERY_BLURRED, BLUR_PENALTY).otherwise(0) + F.when(content < LEAST_CONTENT, CONTENT_PENALTY).otherwise(0)
    return F.when(size.isNull(), 0).otherwise(F.greatest(F.lit(0), score(found) - lost))


def valid_duplicates(items: DataFrame, key: str, content: Column, is_valid: Column, width: int = 1 << 16) -> DataFrame:
    """(key, holder): rows whose content an earlier valid row has; holder is the latest of those. Null contents are no
    copies of each other.

    key is a whole number. One content may be that of most rows, so rows are dealt by content and range of width keys; a
    range's first rows take what the ranges before it hold, of which a content has one row each.
    """
    keyed = items.select(F.col(key), F.md5(content.cast("binary")).alias("hash"), is_valid.alias("valid")).filter(F.col("hash").isNotNull() & F.col(key).isNotNull())
    keyed = keyed.withColumn("part", F.floor(F.col(key) / width))
    held = F.when(F.col("valid"), F.col(key))
    within = Window.partitionBy("hash", "part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy("hash", "part").agg(F.max(held).alias("top"))
    passed = ranges.withColumn("passed", F.max("top").over(Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).filter("passed IS NOT NULL")
    x = keyed.withColumn("own", F.max(held).over(within)).join(passed.drop("top"), ["hash", "part"], "left")
    return x.select(key, F.coalesce("own", "passed").alias("holder")).filter("holder IS NOT NULL")
