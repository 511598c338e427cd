"""Bloom filters of built-in functions, tested without a join.

The 64-bit words of a filter are one row of a small table in the shared folder, an array of pages of PAGE words. A plan
reads that row by a scalar subquery, so it holds no word of it, and plans stay small whatever the filter's size.

Edge cases: without keys nothing passes; null is a key like any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import stage_table

HASHES = 4
#: Share of other keys that a filter lets through, if nothing else is asked for: 6 bits a key.
RATE = 0.056
#: Most bits of a pre-filter (16 MiB): beyond its keys it lets more rows through, and is still right.
MOST_BITS = 1 << 27
PAGE = 4096


def positions(key: Column, bits: int, seed: int) -> list[Column]:
    """Double hashing: the bits of a key."""
    low = F.lit((1 << 60) - 1)
    h = F.xxhash64(F.lit(seed), key)
    a, b = h.bitwiseAND(low), F.xxhash64(F.lit(seed), h).bitwiseAND(low)
    return [(a + F.lit(i) * b) % F.lit(bits) for i in range(HASHES)]


@dataclass(frozen=True)
class Bloom:
    bits: int
    seed: int
    table: DataFrame

    def passes(self, key: Column) -> Column:
        pages, out = self.table.scalar(), None
        for p in positions(key, self.bits, self.seed):
            w = F.shiftright(p, 6)
            word = F.get(F.get(pages, (w / PAGE).cast("int")), (w % PAGE).cast("int"))
            hit = F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1
            out = hit if out is None else out & hit
        return out


def bits_for(n: int, rate: float = RATE) -> int:
    """Bits for n keys, in whole words."""
    return 64 * max(1, math.ceil(n * -HASHES / math.log(1 - rate ** (1 / HASHES)) / 64))


def build(keys: DataFrame, bits: int, seed: int = 1) -> Bloom:
    """keys: one column. Words are combined before the shuffle; the table's one row has bits / 64 of them."""
    at = keys.select(F.explode(F.array(*positions(F.col(f"`{keys.columns[0]}`"), bits, seed))).alias("p"))
    set_ = at.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = set_.unionByName(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    in_order = lambda a, b: F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda x: x[b])
    pages = words.groupBy(F.floor(F.col("w") / PAGE).alias("page")).agg(in_order("w", "b").alias("words"))
    return Bloom(bits, seed, stage_table(pages.agg(in_order("page", "words").alias("pages")), "bloom"))


def prefilter(keys: DataFrame, n: int, seed: int = 1) -> Bloom:
    """A filter over n keys, of MOST_BITS at most."""
    return build(keys, min(MOST_BITS, bits_for(n)), seed)
