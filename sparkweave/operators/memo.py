"""Caches as tables: (key, value, cached_at, expires_at), looked up by joins, and the counters a cache has."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_key(v: Column, k: int, engine: str, metric: str) -> Column:
    """A key of a search: the vector's first hundred numbers, k, engine and metric."""
    return F.md5(F.concat_ws("|", F.to_json(F.slice(v, 1, 100)), F.lit(k), F.lit(engine), F.lit(metric)).cast("binary"))


def number_key(digest: Column) -> Column:
    """A digest's first eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def alive(memo: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired; one without expires_at never does. Of several for a key the last counts."""
    last = memo.groupBy("key").agg(F.max_by(F.struct("value", "cached_at", "expires_at"), "cached_at").alias("x")).select("key", "x.*")
    return last.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def hits(asked: DataFrame, memo: DataFrame, now: Column) -> DataFrame:
    """Rows of asked (key, ...) with the value their key has."""
    return asked.join(alive(memo, now).select("key", "value"), "key")


def misses(asked: DataFrame, memo: DataFrame, now: Column) -> DataFrame:
    """Rows of asked whose key has no value."""
    return asked.join(alive(memo, now).select("key"), "key", "left_anti")


def entries(values: DataFrame, now: Column, seconds: int | None) -> DataFrame:
    """(key, value) as entries; seconds: their life."""
    return values.select("key", "value", now.alias("cached_at"), (now + F.make_dt_interval(secs=F.lit(seconds)) if seconds is not None else F.lit(None).cast("timestamp")).alias("expires_at"))


def through(asked: DataFrame, memo: DataFrame, work, now: Column, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(asked with values, new entries): work computes (key, value) for the keys that miss, each once."""
    fresh = entries(work(misses(asked, memo, now).dropDuplicates(["key"])), now, seconds)
    return hits(asked, memo, now).unionByName(asked.join(fresh.select("key", "value"), "key"), allowMissingColumns=True), fresh


def cleared(memo: DataFrame, pattern: str) -> DataFrame:
    """Without the keys that match the pattern, whose * stands for anything."""
    return memo.filter(~F.col("key").like(pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")))


def rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0))


def replay(log: DataFrame, capacity: int, cache: str = "cache", at: str = "at") -> DataFrame:
    """(cache, hits, misses, evictions, size, hit_rate) of a least-recently-used cache for the accesses (cache, at, key).

    A miss stores its key; an access moves it to the front. The order of one cache is one sequence, so a cache is
    replayed by one task, which reads its log in pieces and holds no more than capacity keys.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    kind = log.schema[cache].dataType.simpleString()
    spread = log.select(cache, at, "key").repartition(cache).sortWithinPartitions(cache, at, "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: object = None
        kept: OrderedDict = OrderedDict()
        n = [0, 0, 0]
        seen = False

        def row() -> pd.DataFrame:
            return pd.DataFrame([[done, *n, len(kept)]], columns=[cache, "hits", "misses", "evictions", "size"])

        for batch in batches:
            for name, key in zip(batch[cache].tolist(), batch["key"].tolist(), strict=True):
                if not seen or name != done:
                    if seen:
                        yield row()
                    done, kept, n, seen = name, OrderedDict(), [0, 0, 0], True
                if key in kept:
                    n[0] += 1
                    kept.move_to_end(key)
                    continue
                n[1] += 1
                kept[key] = True
                if len(kept) > capacity:
                    kept.popitem(last=False)
                    n[2] += 1
        if seen:
            yield row()

    out = spread.mapInPandas(run, f"`{cache}` {kind}, hits bigint, misses bigint, evictions bigint, size bigint")
    return out.withColumn("hit_rate", F.round(rate(F.col("hits"), F.col("misses")), 6))


def two_levels(asked: DataFrame, first: DataFrame, second: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(asked with value and level, entries for the first level): the second level is asked for what the first lacks, and
    what it has is promoted, with the life it has left."""
    one = alive(first, now).select("key", F.col("value").alias("value_1"))
    two = alive(second, now).select("key", F.col("value").alias("value_2"), "cached_at", "expires_at")
    x = asked.join(one, "key", "left").join(two, "key", "left")
    level = F.when(F.col("value_1").isNotNull(), "first").when(F.col("value_2").isNotNull(), "second").otherwise("miss")
    x = x.withColumn("level", level)
    promoted = x.filter("level = 'second'").select("key", F.col("value_2").alias("value"), now.alias("cached_at"), "expires_at").dropDuplicates(["key"])
    return x.withColumn("value", F.coalesce("value_1", "value_2")).drop("value_1", "value_2", "cached_at", "expires_at"), promoted
