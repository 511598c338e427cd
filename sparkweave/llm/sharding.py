"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to logical parts by a hash of their key. How many rows of each part go to each shard is drawn
from the multivariate hypergeometric law with the shards' exact sizes as margins: that is the law of these counts
under a uniform permutation of all rows. Each part is permuted on its own (a keyed hash order) and cut by its row of
the matrix, rows are exchanged, and each shard is permuted again by an independent hash. Shards differ by one row at
most. The matrix depends on the counts and the seed alone, so reruns and recomputed tasks agree.

A shard is ordered in sub-ranges of the second hash, with offsets from counts, so no task sorts a whole shard. Parts
hold about rows_per_part rows whatever the keys or sources are: hashing the key with the row's own hash spreads
equal keys and copies too.

Edge cases: null keys are hashed like any value; rows that are equal in all columns are interchangeable; fewer rows
than shards leave shards with no row; an empty table gives an empty result; extra columns are carried inside one
struct, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import free_name, row_hash, stage_table

ROWS_PER_PART = 100_000
#: Cells of the matrix up to which it is broadcast (8 bytes each); beyond it, a join on the part.
MAX_BROADCAST_CELLS = 1 << 21


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw; beyond numpy's limit of 10**9, inversion outwards from the mode."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    lo, hi = max(0, draws - bad), min(good, draws)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    at = lambda k: math.exp(lg(good + 1) - lg(k + 1) - lg(good - k + 1) + lg(bad + 1) - lg(draws - k + 1) - lg(bad - draws + k + 1) - lg(good + bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1))
    u = rng.random() - at(mode)
    a, b = mode - 1, mode + 1
    while u > 0 and (a >= lo or b <= hi):
        if a >= lo:
            u, a, last = u - at(a), a - 1, a
            if u <= 0:
                return last
        if b <= hi:
            u, b, last = u - at(b), b + 1, b
            if u <= 0:
                return last
    return mode


def communication_matrix(part_rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of part p that go to shard s; row sums are part_rows, column sums are sizes."""
    assert sum(part_rows) == sum(sizes)
    rng, left, out = np.random.Generator(np.random.PCG64(seed)), list(sizes), []
    for n in part_rows:
        row, rest, total = [], n, sum(left)
        for k in left:
            x = _hypergeometric(rng, k, total - k, rest) if rest else 0
            row.append(x)
            rest, total = rest - x, total - k
        out.append(row)
        left = [a - b for a, b in zip(left, row, strict=True)]
    return out


def assign_shards(df: DataFrame, key: str, shards: int, seed: int = 17, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with columns shard (int) and slot (long, gapless from 0 in each shard) beside a struct ``row`` of df's own."""
    spark = df.sparkSession
    tie = row_hash(df)
    rows = df.select(F.struct("*").alias("row"), F.xxhash64(F.lit(seed), F.col(f"`{key}`"), tie).alias("h1"), F.xxhash64(F.lit(seed + 1), F.col(f"`{key}`"), tie).alias("h2"), tie.alias("tie"))
    n = df.count()
    parts = max(1, -(-n // rows_per_part))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 2), "h1"), F.lit(parts)).cast("int"))
    counted = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
    matrix = communication_matrix([counted.get(p, 0) for p in range(parts)], shard_sizes(n, shards), seed)
    ends = spark.createDataFrame([(p, [int(x) for x in np.cumsum(row)]) for p, row in enumerate(matrix)], "part int, ends array<bigint>")
    ends = F.broadcast(ends) if parts * shards <= MAX_BROADCAST_CELLS else ends
    local = rows.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("h1", "tie")))
    sent = local.join(ends, "part").withColumn("shard", F.size(F.filter("ends", lambda x: x < F.col("rn"))).cast("int"))
    bits = max(0, math.ceil(math.log2(max(1, n / shards / rows_per_part))))
    sub = F.shiftrightunsigned("h2", 64 - bits).cast("int") if bits else F.lit(0)
    sent = stage_table(sent.select("row", "shard", "h2", "tie", sub.alias("sub")), "shard-exchange")
    sizes = sent.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("before"))
    before = F.broadcast(before) if shards << bits <= MAX_BROADCAST_CELLS else before
    placed = sent.withColumn("at", F.row_number().over(Window.partitionBy("shard", "sub").orderBy("h2", "tie")))
    return placed.join(before, ["shard", "sub"]).select("row", "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"))


def shuffle_documents(docs: DataFrame, key: str, shards: int, seed: int = 17, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """docs, all columns, with shard and slot. Places are drawn on narrow rows; the wide rows move once, by their key.

    Rows that are equal in all columns take the places of their group in order. Columns of docs that are called shard or
    slot get an underscore after their names.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.col(f"`{key}`").alias("k"), row_hash(docs).alias("tie"))
    placed = assign_shards(keyed.select("k", "tie"), "k", shards, seed, rows_per_part)
    places = placed.groupBy(F.col("row.k").alias("k"), F.col("row.tie").alias("tie")).agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("places"))
    at = keyed.withColumn("i", F.row_number().over(Window.partitionBy("k", "tie").orderBy(F.lit(0))))
    got = at.join(places, at["k"].eqNullSafe(places["k"]) & (at["tie"] == places["tie"]))
    place = F.get("places", F.col("i") - 1)
    own = {c: free_name(f"{c}_", docs.columns) if c.lower() in ("shard", "slot") else c for c in docs.columns}
    return got.select(*(F.col("doc").getField(c).alias(own[c]) for c in docs.columns), place["shard"].alias("shard"), place["slot"].alias("slot"))
