"""Exact Jaccard similarity join on word shingles by T-occurrence search (DivideSkip).

A document's set is its distinct 5-word shingles (64-bit hashes). Two sets x, y with J >= 0.8 share at least
T = 0.8 max(|x|, |y|) shingles. The search never looks at all inverted lists:

1. Divide. In one fixed order (by hash) the first |x| - T + l shingles of both sets share at least l of them, with
   l = 0.2 |x| of the smaller set, and so at least m = 0.16 |x| whichever of both x is. A set of whose prefix fewer
   than m shingles are in any other prefix has no partner and drops out, which happens to nearly every document.
   Among the sets that are left all inverted lists are made; a set with fewer than T shared shingles drops out, and
   of the others the T - 1 longest lists are put aside. A partner occurs in one of the short lists at least.
   Lists are found by dealing shingles to tasks. Hot shingles, of which a task would get many, are known from counts in
   slices of the texts beforehand; they count as shared by all that have them and aren't dealt.
2. Merge. The short lists are merged by a Spark aggregation that counts, for a query set and a candidate, the short
   lists both are in. To leave large groups of near copies without all their pairs, a list first pairs its centre
   (the set with the least share of shingles of its own) with the others; as components are what is asked, pairs
   inside one component need no test. Lists that still hold several components are paired off from another centre,
   and last with every pair across components whose shared shingles could reach the overlap.
3. Skip. A candidate's sorted array is probed by binary search with the query's remaining shingles, until the
   required overlap is reached or out of reach.

Sets that are equal are one class throughout (id: a hash of the set), so copies cost nothing but a row. Links are
joined to components by large-star and small-star rounds. Hashes of 64 bits stand for words and shingles, and of 128
for sets: sets that are alike in the first 64 only get ids of their own.

Edge cases: null or blank texts have an empty set and link with nothing; with one to four words the sequence is the
one shingle; repeated ids are documents of their own with that id; null ids are no least id of a component that has
others, and a component of null ids alone has a null id; an empty table gives an empty result. Extra columns are not
carried by components, and all by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm import bloom
from sparkweave.llm.arrow import Words, mix64, slices
from sparkweave.llm.common import free_name, row_hash, shuffle_partitions, stage_table

WIDTH = 5
STAR_ROUNDS = 2
#: A shingle is counted that is in so many sets of a slice, and hot if it has this part of a task's rows.
OFTEN, HOT = 16, 20
#: What both sets could share at most, as no set shares its own shingles, reaches the overlap that J >= 0.8 asks for.
OVERLAP = "9 * least(n - own, m - o) >= 4 * (n + m)"
_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (UTF-8)."""
    words = Words(texts)
    flat = words.hashes
    full = np.zeros(max(0, len(flat) - WIDTH + 1), np.uint64)
    for j, c in enumerate(_MULTIPLIERS):
        full += flat[j : len(flat) - WIDTH + 1 + j] * c if len(full) else full
    full = mix64(full)
    out = []
    for at, n in zip(words.firsts.tolist(), words.counts.tolist(), strict=True):
        if n >= WIDTH:
            s = np.sort(full[at : at + n - WIDTH + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            h = np.full(1, n, np.uint64)
            for x in flat[at : at + n]:
                h = mix64(h ^ x) + np.uint64(1)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """The halves of each set's 128-bit hash."""
    got = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64)
    return pa.array(got[0::2]), pa.array(got[1::2])


def _often(sets: list[np.ndarray]) -> list[dict]:
    """The shingles that come up in several sets of a slice, with counts: OFTEN times, or in a hundredth of the sets."""
    all_ = np.concatenate([np.zeros(0, np.uint64), *sets])
    least = max(OFTEN, len(sets) // 100)
    bucket = (all_ >> np.uint64(48)).astype(np.intp)
    h, n = np.unique(all_[np.bincount(bucket, minlength=1 << 16)[bucket] >= least], return_counts=True)
    return [{"h": x, "n": c} for x, c in zip(h.view(np.int64)[n >= least].tolist(), n[n >= least].tolist(), strict=True)]


_OFTEN = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))


def _classes(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """often: of the whole slice, in its first row."""
    for part, texts in slices(batches):
        sets = shingle_sets(texts)
        often = pa.array([_often(sets), *[None] * (len(sets) - 1)], _OFTEN)
        yield pa.RecordBatch.from_arrays([part.column(key), *set_ids(sets), pa.array([len(s) for s in sets], pa.int64()), often], names=[key, "sig", "check", "n", "often"])


def one_each(classes: DataFrame) -> DataFrame:
    """classes with raw, the first half of the hash, and sig, which is another where several sets are alike in it. With n
    distinct sets n^2 / 2^65 of these are to be expected."""
    clash = [r.sig for r in classes.groupBy("sig").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b").collect()]
    return classes.withColumn("raw", F.col("sig")).withColumn("sig", _sig(clash)) if clash else classes.withColumn("raw", F.col("sig"))


def _sig(clash: list[int]) -> Column:
    return F.when(F.col("sig").isin(clash), F.xxhash64("sig", "check")).otherwise(F.col("sig"))


def hot_shingles(classes: DataFrame) -> dict[int, int]:
    """Those of which a task would get a HOT-th of its rows or more, with their counts: HOT for each partition at most."""
    spark = classes.sparkSession
    least = max(4 * OFTEN, classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // (HOT * shuffle_partitions(spark)))
    each = classes.select(F.inline("often")).groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {r.h: r.n for r in each.collect()}


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + (n + 4) // 5


def least_shared(n: Column) -> Column:
    return F.floor((n * 4 + 24) / 25).cast("int")


def _prefixes(hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, sig, x): x is the set's size, and beyond 32 bits how many hot shingles a row stands for, whose h is any."""
    task = TaskContext.get().partitionId()
    for turn, (_, texts) in enumerate(slices(batches)):
        some = [s for s in shingle_sets(texts) if len(s)]
        ids = np.asarray(set_ids(some)[0])
        ids, at = np.unique(ids, return_index=True)
        some = [some[i] for i in at]
        first = [s[: prefix_length(len(s))] for s in some]
        of = np.repeat(np.arange(len(some)), [len(p) for p in first])
        size = np.array([len(s) for s in some], np.int64)
        h = np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)
        is_hot = np.isin(h, hot)
        warm = np.bincount(of[is_hot], minlength=len(some))
        any_ = np.flatnonzero(warm)
        salt = mix64(ids[any_].view(np.uint64) + np.uint64((task << 32) + turn)).view(np.int64)
        cold = of[~is_hot]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[~is_hot], salt])), pa.array(np.concatenate([ids[cold], ids[any_]])), pa.array(np.concatenate([size[cold], size[any_] | warm[any_] << 32]))], names=["h", "sig", "x"])


def _sets(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        sets = shingle_sets(texts)
        yield pa.RecordBatch.from_arrays([part.column(key), *set_ids(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=[key, "sig", "check", "set"])


def _shingles(hot: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, sig, n, length) of all shingles; length: the count of a hot one, else 0."""
    known = np.array(sorted(hot), np.int64)
    length = np.array([hot[h] for h in known.tolist()] + [0], np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("set")]
            size = np.array([len(x) for x in sets], np.int32)
            h = np.concatenate(sets)
            i = np.searchsorted(known, h)
            i[np.append(known, 0)[i] != h] = len(known)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(np.asarray(part.column("sig")), size)), pa.array(np.repeat(size, size)), pa.array(length[i])], names=["h", "sig", "n", "length"])


def divide_skip(query: np.ndarray, other: np.ndarray, block: int = 64) -> bool:
    """Whether 100 * overlap >= 80 * union: the query's shingles probe the sorted other set by binary search, in blocks,
    until the required overlap is reached or can't be any more."""
    if len(query) > len(other):
        query, other = other, query
    need = -(-4 * (len(query) + len(other)) // 9)
    got, left = 0, len(query)
    while left and got < need <= got + left:
        part = query[len(query) - left : len(query) - left + block]
        at = np.searchsorted(other, part)
        got += int((other[np.minimum(at, len(other) - 1)] == part).sum())
        left -= len(part)
    return got >= need


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("set_a"), batch.column("set_b")
        keep = [divide_skip(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(a, b, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def candidates(docs: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(sig) of the sets that may have a partner, by their prefixes. docs: (id, text). Copies count twice, which only
    lets more through."""
    known = np.array(sorted(hot), np.int64)
    rows = docs.select("text").mapInArrow(lambda b: _prefixes(known, b), "h bigint, sig bigint, x bigint")
    of = Window.partitionBy("h")
    more = F.when(F.col("x") >= 1 << 32, F.shiftright("x", 32)).otherwise((F.min("sig").over(of) != F.max("sig").over(of)).cast("long"))
    shared = rows.select("sig", F.col("x").bitwiseAND(F.lit((1 << 32) - 1)).alias("n"), more.alias("more")).filter("more > 0").groupBy("sig", "n").agg(F.sum("more").alias("shared"))
    return stage_table(shared.filter(F.col("shared") >= least_shared(F.col("n"))).select("sig"), "jaccard-candidates")


def short_lists(sets: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(length, h, sig, n, own): the short lists that each set is in. own: its shingles that no other set has."""
    rows = sets.mapInArrow(lambda b: _shingles(hot, b), "h bigint, sig bigint, n int, length bigint")
    shared = rows.filter("length = 0").withColumn("length", F.count("*").over(Window.partitionBy("h"))).filter("length > 1")
    shared = shared.unionByName(rows.filter("length > 0"))
    shared = shared.groupBy("sig", "n").agg(F.array_sort(F.collect_list(F.struct("length", "h"))).alias("shared"))
    need = F.floor((F.col("n") * 4 + 4) / 5).cast("int")
    short = shared.filter(F.size("shared") >= need).withColumn("x", F.explode(F.slice("shared", F.lit(1), F.size("shared") - need + 1)))
    return stage_table(short.select(F.col("x.length").alias("length"), F.col("x.h").alias("h"), "sig", "n", (F.col("n") - F.size("shared")).alias("own")), "jaccard-short")


def _sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(sig, set) of the classes in ids, from one document of each; a Bloom filter spares most texts."""
    one = classes.join(ids.select(F.col("sig").alias("raw")), "raw", "left_semi").groupBy("sig", "raw", "check").agg(F.min(key).alias(key))
    one = stage_table(one, "jaccard-ones")
    maybe = bloom.prefilter(one.select(key), one.count())
    sets = docs.filter(maybe.passes(F.col(key))).mapInArrow(lambda b: _sets(key, b), f"`{key}` {docs.schema[key].dataType.simpleString()}, sig bigint, check bigint, set binary")
    one = one.select(F.col(key).alias("one_key"), F.col("sig").alias("one_sig"), "raw", F.col("check").alias("one_check"))
    mine = F.col(key).eqNullSafe(F.col("one_key")) & (F.col("sig") == F.col("raw")) & (F.col("check") == F.col("one_check"))
    return stage_table(sets.join(one, mine).dropDuplicates(["one_sig"]).select(F.col("one_sig").alias("sig"), "set"), "jaccard-sets")


def _test(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    a, b = (sets.select(F.col("sig").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    return stage_table(pairs.join(b, "b").join(a, "a").mapInArrow(_verify, "a bigint, b bigint"), "jaccard-links")


def connected(edges: DataFrame) -> DataFrame:
    """(sig, root): root is the least sig of the component, for every sig that has an edge (a, b)."""
    star = stage_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    state = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage_table(large, "components-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        star = stage_table(small.filter("u <> v").distinct(), "components-small")
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return star.select(F.col("u").alias("sig"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("sig"), F.col("v").alias("root")).distinct())
        state = now


def _grouped(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, sig, n) of every document, (sig, first, copies, root) of every set class). docs: (key, text)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    hashed = stage_table(docs.mapInArrow(lambda b: _classes(key, b), f"`{key}` {kind}, sig bigint, check bigint, n bigint, often array<struct<h: bigint, n: bigint>>"), "jaccard-classes")
    hot = hot_shingles(hashed)
    classes = one_each(hashed.drop("often"))
    maybe = candidates(docs, hot)
    links = spark.createDataFrame([], "a bigint, b bigint")
    if not maybe.isEmpty():
        sets = _sets_of(docs, classes, maybe, key)
        rows = short_lists(sets, hot)
        tested, turn = links, 0
        while turn <= STAR_ROUNDS:
            root = connected(links) if turn else spark.createDataFrame([], "sig bigint, root bigint")
            left = rows.join(root, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
            # the centre: the set with the least share of its own shingles, which most of its list links with
            order = F.struct((F.col("own") / F.col("n")).alias("share") if turn == 0 else F.xxhash64(F.lit(turn), "sig").alias("share"), "sig", "n", "own", "root")
            several = left.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min(order).alias("c")).filter("x <> y")
            left = left.join(stage_table(several.select("h", "c"), "jaccard-several"), "h")
            if turn < STAR_ROUNDS:
                pairs = left.select(F.col("c.sig").alias("p"), F.col("c.n").alias("m"), F.col("c.own").alias("o"), F.col("c.root").alias("r"), "sig", "n", "own", "root").filter(f"root <> r AND {OVERLAP}")
            else:
                # a pair comes up in the first list only that both are in
                left = stage_table(left.select("length", "h", "sig", "n", "own", "root"), "jaccard-left")
                mine = left.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("length", "h"))).alias("lists"))
                left = left.join(mine, "sig").withColumn("before", F.transform(F.filter("lists", lambda x: x < F.struct("length", "h")), lambda x: x["h"])).drop("lists")
                other = left.select("h", F.col("sig").alias("p"), F.col("n").alias("m"), F.col("own").alias("o"), F.col("root").alias("r"), F.col("before").alias("earlier"))
                pairs = left.join(other, (left["h"] == other["h"]) & F.expr(f"sig < p AND root <> r AND {OVERLAP} AND NOT arrays_overlap(before, earlier)"))
            pairs = pairs.select(F.least("p", "sig").alias("a"), F.greatest("p", "sig").alias("b"))
            # merged short lists: a row for each candidate, however many of them it is in
            pairs = stage_table(pairs.groupBy("a", "b").agg(F.count("*").alias("occurs")).select("a", "b").join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
            if not pairs.isEmpty():
                tested = tested.unionByName(pairs)
                links = links.unionByName(_test(pairs, sets))
            elif turn < STAR_ROUNDS:
                turn = STAR_ROUNDS  # no centre has a new pair, but others in their lists may have: the last round sees all
                continue
            turn += 1
    firsts = classes.groupBy("sig").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    if links.isEmpty():
        return classes, firsts.withColumn("root", F.col("sig"))
    return classes, firsts.join(connected(links), "sig", "left").withColumn("root", F.coalesce("root", "sig"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, set_class, copies) of every document; component_id: least key reachable by links."""
    classes, firsts = _grouped(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")), key)
    of = firsts.groupBy("root").agg(F.min("first").alias("least"))
    firsts = stage_table(firsts.join(of, "root").select("sig", "first", "least", "copies"), "jaccard-firsts")
    got = classes.join(firsts, "sig")
    alone = F.col("n") == 0
    return got.select(key, F.col("n").alias("n_shingles"), F.when(alone, F.col(key)).otherwise(F.col("least")).alias("component_id"), F.when(alone, F.col(key)).otherwise(F.col("first")).alias("set_class"), F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("copies"))


def _with_class(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        sets = shingle_sets(texts)
        for name, x in zip(names, (*set_ids(sets), pa.array([len(s) for s in sets], pa.int64())), strict=True):
            part = part.append_column(name, x)
        yield part


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each component, with all columns: of the least key, then set, then row. Ids may be null or clash: rows
    go by what is in them. Rows without a word link with nothing; only a repeat of the whole row, with an id, goes. Columns
    may have any names."""
    classes, firsts = _grouped(docs.select(F.col(key), "text"), key)
    rep = firsts.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "sig")).alias("rep"))
    firsts = stage_table(firsts.join(rep, "root").select("sig", F.col("rep.sig").alias("rep"), F.col("rep.first").alias("least")), "jaccard-firsts")
    gone = classes.filter("n > 0").join(firsts, "sig").filter((F.col("sig") != F.col("rep")) | ~F.col(key).eqNullSafe(F.col("least")))
    gone_key, gone_sig, gone_check, sig, check, n = (free_name(x, docs.columns) for x in ("gone_key", "gone_sig", "gone_check", "set_sig", "set_check", "set_n"))
    gone = gone.select(F.col(key).alias(gone_key), F.col("raw").alias(gone_sig), F.col("check").alias(gone_check)).distinct()
    rows = docs.mapInArrow(lambda b: _with_class([sig, check, n], b), T.StructType([*docs.schema, *(T.StructField(x, T.LongType()) for x in (sig, check, n))]))
    rest = rows.join(gone, F.col(key).eqNullSafe(F.col(gone_key)) & (F.col(sig) == F.col(gone_sig)) & (F.col(check) == F.col(gone_check)), "left_anti")
    tied = rest.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(key).alias("k"), F.col(sig).alias("sig"), F.col(check).alias("check"), F.col(n).alias("n"), row_hash(docs).alias("tie"))
    blank = F.col("n") == 0
    tied = tied.withColumn("apart", F.when(blank & F.col("k").isNull(), F.monotonically_increasing_id()).when(blank, F.col("tie")).otherwise(0))
    first = Window.partitionBy("k", "sig", "check", "apart").orderBy("tie")
    return tied.withColumn("i", F.row_number().over(first)).filter("i = 1").select("doc.*")
