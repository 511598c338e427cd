"""Mixing sources to target weights: hash-random order in each source, cut at the source's exact word budget.

Every document gets a hash-random key. In each source the keys are dealt to ranges, the ranges' token sums give a
distributed prefix sum, and only the one range in which the budget ends is sorted to find the cut. A source whose
budget exceeds its size is repeated in whole epochs first. The cut is one (key, tie) per source: documents below it
get a copy more, the document at it gets the words that are left. Applying it is a projection over the scan, so the
texts are never shuffled.

Targets share ``factor`` times all sizes by weight; a target stops at ``cap`` times its source's size, and the excess
is shared again by weight until none is above (closed form: sources in order of cap by weight).

Edge cases: a null source is a source of its own, last in order; null or blank texts have size 0 and take nothing;
a source of size 0 has target 0. Rows that are equal in key, text and source share a place; where the cut falls on them, each
takes the whole part of an equal share. An empty table gives an empty result. Extra columns are carried by mix, inside
one struct, and not by mix_sizes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import WORD, stage_table

WEIGHTS = (3, 1, 2)
FACTOR, CAP = 1.5, 2
#: Rows of a range, at any size of the table: the one task that sorts the range of a source's cut has about as many.
ROWS_PER_RANGE = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, factor: float = FACTOR, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source, so one task takes them."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rank = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    all_ = Window.partitionBy(F.lit(0))
    x = sizes.withColumn("r", rank).withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    x = x.withColumn("total", F.lit(factor) * F.sum("source_size").over(all_)).withColumn("w_all", F.sum("w").over(all_))
    before = all_.orderBy(F.col("most") / F.col("w"), "r").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0))).withColumn("t_left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    x = x.withColumn("full", F.col("most") * F.col("w_left") <= F.col("w") * F.col("t_left"))
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(all_)
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(all_)
    x = x.withColumn("free", free).withColumn("rest", rest)
    return x.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * F.col("rest") / F.nullif(F.col("free"), F.lit(0.0))).alias("target"))


def places(key: Column, text: Column, source: Column, seed: int) -> tuple[Column, Column]:
    """The hash-random order: two numbers of 60 bits, of md5 so that SQL elsewhere can say the same."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), blank(key.cast("string")), blank(F.md5(text)), blank(source.cast("string"))))
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 17))


def keyed(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """docs as a struct, with source, size, and the hash-random order (h, tie)."""
    t, s = F.col(f"`{text}`"), F.col(f"`{source}`")
    h, tie = places(F.col(f"`{key}`"), t, s, seed)
    return docs.select(F.struct("*").alias("doc"), s.alias("source"), word_count(t).alias("size"), h.alias("h"), tie.alias("tie"))


def cuts(rows: DataFrame, weights: Sequence[int] = WEIGHTS, factor: float = FACTOR, cap: int = CAP) -> DataFrame:
    """One row for each source: source_size, target, epochs, and the cut (cut_h, cut_tie, part) of the epoch after those.

    rows: (source, size, h, tie). part: words that each document at the cut takes.
    """
    n = rows.count()
    bits = max(1, math.ceil(math.log2(max(2, n / ROWS_PER_RANGE))))
    ranged = rows.withColumn("range", F.shiftright(F.col("h"), 60 - bits))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, factor, cap)
    budget = F.floor("target")
    goals = goals.withColumn("epochs", F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    goals = stage_table(goals.withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")), "mix-goals")
    at = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("range")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    here = at.join(F.broadcast(goals), same(at, goals)).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    here = here.select(at["source"].alias("s"), F.col("range").alias("g"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    inside = ranged.join(F.broadcast(here), ranged["source"].eqNullSafe(here["s"]) & (ranged["range"] == here["g"]))
    equal = inside.groupBy("s", "left", "h", "tie").agg(F.sum("size").alias("words"), F.count("*").alias("same"))
    run = equal.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("h", "tie")))
    cut = run.filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
    cut = cut.select("s", F.col("h").alias("cut_h"), F.col("tie").alias("cut_tie"), F.floor((F.col("left") - F.col("upto") + F.col("words")) / F.col("same")).cast("long").alias("part"))
    return stage_table(goals.join(cut, goals["source"].eqNullSafe(cut["s"]), "left").drop("s", "rest"), "mix-cuts")


def take(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows with source_size, target, epochs (whole copies) and part (words of one copy more that isn't whole)."""
    c = F.broadcast(cut.withColumnRenamed("source", "s"))  # one row for each source
    x = rows.join(c, rows["source"].eqNullSafe(c["s"])).drop("s")
    at = (F.col("h") == F.col("cut_h")) & (F.col("tie") == F.col("cut_tie"))
    below = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("tie") < F.col("cut_tie")))
    x = x.withColumn("epochs", F.col("epochs") + F.when(F.coalesce(below, F.lit(False)), 1).otherwise(0))
    return x.withColumn("part", F.when(F.coalesce(at, F.lit(False)), F.least("part", "size")).otherwise(F.lit(0)).cast("long")).drop("cut_h", "cut_tie")


def mix_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 29) -> DataFrame:
    """(key, size, source_size, target, taken) of every document."""
    rows = keyed(docs, key, text, source, seed).select(F.col("doc").getField(key).alias(key), "source", "size", "h", "tie")
    rows = stage_table(rows, "mix-rows")
    got = take(rows, cuts(rows.select("source", "size", "h", "tie")))
    return got.select(key, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "source")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 29) -> DataFrame:
    """The mix itself, with the columns of docs: whole copies by epoch, and at a source's cut the text's first words."""
    rows = keyed(docs, key, text, source, seed)
    narrow = stage_table(rows.select("source", "size", "h", "tie"), "mix-rows")
    got = take(rows, cuts(narrow))
    words = F.expr(f"array_join(slice(regexp_extract_all(doc.`{text}`, '([^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*)', 1), 1, cast(part as int)), '')")
    whole = got.filter("epochs > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("doc")
    cut = got.filter("part > 0").select(F.col("doc").withField(text, F.rtrim(words)).alias("doc"))
    if "n_chars" in docs.columns and text != "n_chars":
        cut = cut.select(F.col("doc").withField("n_chars", F.length(F.col("doc").getField(text)).cast(docs.schema["n_chars"].dataType)).alias("doc"))
    return whole.unionByName(cut).select("doc.*")
