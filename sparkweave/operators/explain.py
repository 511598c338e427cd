"""Explanations of ranked results: component scores, confidence, bands and concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands as (limit, value), first that fits; confidence weights.
DISTANCE_PHRASES = ((0.4, "nearly identical"), (0.7, "very similar"), (1.1, "similar"), (1.6, "somewhat similar"))
SUPPORT = ((100, 1.0), (50, 0.8), (20, 0.6), (10, 0.4))
LEVELS = ((0.90, "very high"), (0.75, "high"), (0.50, "medium"), (0.25, "low"))
CONFIDENCE = {"distance": 0.5, "rank": 0.2, "support": 0.2, "source": 0.1}


def distance_phrase(distance: Column) -> Column:
    out = F.lit("different")
    for limit, text in reversed(DISTANCE_PHRASES):
        out = F.when(distance < limit, text).otherwise(out)
    return out


def support(count: Column) -> Column:
    out = F.lit(0.2)
    for limit, s in reversed(SUPPORT):
        out = F.when(count > limit, s).otherwise(out)
    return out


def rank_score(position: Column, total: Column) -> Column:
    """position from 0."""
    return 1 - position / F.greatest(total, F.lit(10))


def confidence(distance: Column, position: Column, total: Column, count: Column, source: Column) -> Column:
    w = CONFIDENCE
    return w["distance"] * F.exp(-distance) + w["rank"] * rank_score(position, total) + w["support"] * support(count) + w["source"] * source


def level(c: Column) -> Column:
    out = F.lit("very low")
    for limit, text in reversed(LEVELS):
        out = F.when(c >= limit, text).otherwise(out)
    return out


def concerns(c: Column, distance: Column, position: Column, count: Column) -> Column:
    """The rules that apply, joined by commas."""
    rules = F.array(F.when(c < 0.5, "low confidence"), F.when(distance > 1.0, "far"), F.when(position > 5, "low rank"), F.when(count < 20, "few examples"))
    return F.array_join(F.array_compact(rules), ",")


def parts(distance: Column, position: Column, total: Column, count: Column, source: Column) -> Column:
    """array<struct<part, score, weight, contribution>>: what the confidence is made of."""
    scores = {"distance": F.exp(-distance), "rank": rank_score(position, total), "support": support(count), "source": source}
    return F.array(*[F.struct(F.lit(n).alias("part"), s.cast("double").alias("score"), F.lit(CONFIDENCE[n]).alias("weight"), (s * CONFIDENCE[n]).cast("double").alias("contribution")) for n, s in scores.items()])


def sentence(level_: Column, species: Column, distance: Column) -> Column:
    return F.format_string("Match of %s confidence: %s at distance %.3f", level_, species, F.round(distance, 3))


#: Confidences nearer than this are a tie.
TIE = 0.05


def compare(pairs: DataFrame) -> DataFrame:
    """pairs with better (a, b or tie) and the part in which the two differ most. pairs: confidence_a, confidence_b,
    parts_a and parts_b as parts() makes them. Of equal gaps the first part counts."""
    gap = F.col("confidence_a") - F.col("confidence_b")
    better = F.when(F.abs(gap) < TIE, "tie").when(gap > 0, "a").otherwise("b")
    gaps = F.zip_with("parts_a", "parts_b", lambda x, y: F.struct(F.round(F.abs(x["contribution"] - y["contribution"]), 6).alias("gap"), x["part"].alias("part")))
    largest = F.array_max(F.transform(gaps, lambda x: x["gap"]))
    return pairs.withColumn("better", better).withColumn("differs_in", F.get(F.filter(gaps, lambda x: x["gap"] == largest), F.lit(0))["part"])


def as_json(row: dict[str, Column], fractions: tuple[str, ...] = ()) -> Column:
    """One row as JSON text; the fields named in fractions are rounded to four decimals."""
    return F.to_json(F.struct(*[(F.round(c, 4) if n in fractions else c).alias(n) for n, c in row.items()]))


def explanation(distance: Column, position: Column, total: Column, count: Column, source: Column, species: Column) -> Column:
    """struct<confidence, level, text, phrase, concerns, parts>: all there is to say of one result; position from 0."""
    c = F.round(confidence(distance, position, total, count, source), 6)
    return F.struct(c.alias("confidence"), level(c).alias("level"), sentence(level(c), species, distance).alias("text"), distance_phrase(distance).alias("phrase"), concerns(c, distance, position + 1, count).alias("concerns"), parts(distance, position, total, count, source).alias("parts"))
