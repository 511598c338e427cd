"""Index and dataset maintenance: upsert, cascade, sync, split, names, sampling, augmentation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new over old, by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_cascade(children: DataFrame, parents: DataFrame, child_key: str, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias(child_key)), child_key, "left_semi")


def sync_report(items: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """(status, n): in both, only in the table, only in the index."""
    a, b = items.select(key, F.lit(1).alias("a")), indexed.select(key, F.lit(1).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").otherwise("indexed")
    return a.join(b, key, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def hash_order(*cols: Column) -> Column:
    """A pseudo-random order that every engine has."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))


def stratified_split(items: DataFrame, key: str, stratum: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """(key, stratum, split): by hash order in each stratum; cuts at the rounded shares.

    A stratum may hold most rows, so places are counted in ranges of the hash: what one task orders are a range's rows, or
    the counts of a stratum's ranges (65,536 at most).
    """
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    x = items.select(key, stratum, hash_order(F.col(key), F.lit(seed)).alias("_order")).withColumn("_range", F.substring("_order", 1, 4))
    of = Window.partitionBy("_stratum")
    counts = x.groupBy(F.col(stratum).alias("_stratum"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    counts = counts.select("_stratum", "_r", (F.sum("_n").over(of.orderBy("_r")) - F.col("_n")).alias("_before"), F.sum("_n").over(of).alias("_all"))
    x = x.withColumn("_at", F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_order", key)))
    items = x.join(counts, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_range") == F.col("_r")))
    at, n = F.col("_before") + F.col("_at"), F.col("_all")
    part = F.when(at <= F.floor(n * ratios[0]), "train").when(at <= F.floor(n * (ratios[0] + ratios[1])), "val").otherwise("test")
    return items.select(key, stratum, part.alias("split"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), " ", "_"), r"[^\p{L}\p{N}_-]", "")


def next_numbers(names: DataFrame, folder: str, name: str) -> DataFrame:
    """(folder, next): greatest sequence in ``id-sequence-number.ext`` plus one; other names are skipped."""
    number = F.expr(f"try_cast(nullif(regexp_extract(`{name}`, '^[^-]*-([0-9]+)-[^/]*[.]', 1), '') AS bigint)")
    return names.groupBy(folder).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def augmentation_plan(items: DataFrame, stratum: str, target: int) -> DataFrame:
    """(stratum, original, added): copies that bring each stratum to the target."""
    return items.groupBy(stratum).agg(F.count("*").alias("original")).withColumn("added", F.greatest(F.lit(target) - F.col("original"), F.lit(0)).cast("long"))


def weighted_sample(rows: DataFrame, key: str, weight: Column, size: int, seed: int = 42) -> DataFrame:
    """Without replacement (Efraimidis-Spirakis), by keys from a hash."""
    u = (F.conv(F.substring(hash_order(F.col(key), F.lit(seed)), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))
    return rows.withColumn("k", -F.log(u) / weight).orderBy("k", key).limit(size).drop("k")


CHANGE = "change_id bigint, ts timestamp, operation string, file_id bigint, species string, image_path string"


def apply_changes(items: DataFrame, changes: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(items after, log) for (change_id, operation, key, species, image_path): add, update or delete.

    Of several changes to a key, the last counts. Null fields of a change keep what was there. An update or deletion of
    an unknown key fails and is logged so; an add of a known key updates it. embed says which rows need a new vector:
    new ones, and those whose path changed.
    """
    last = changes.groupBy(key).agg(F.max_by(F.struct("change_id", "operation", "species", "image_path"), "change_id").alias("x")).select(key, "x.*")
    old = items.select(key, F.col("species").alias("o_species"), F.col("image_path").alias("o_path"), F.lit(True).alias("known"))
    x = old.join(last, key, "full")
    known, op = F.col("known").isNotNull(), F.col("operation")
    after = x.filter((known & (op.isNull() | (op != "delete"))) | (~known & (op == "add")))
    path = F.coalesce("image_path", "o_path")
    after = after.select(key, F.coalesce("species", "o_species").alias("species"), path.alias("image_path"), (~known | ~path.eqNullSafe(F.col("o_path"))).alias("embed"))
    logged = x.filter(op.isNotNull()).select("change_id", key, "operation", (known | (op == "add")).alias("success"))
    return after, logged


def change_stats(log: DataFrame) -> DataFrame:
    """(total, succeeded, failed, added, updated, deleted)."""
    good = F.col("success")
    return log.agg(F.count("*").alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), *[F.count_if(good & (F.col("operation") == o)).alias(n) for o, n in (("add", "added"), ("update", "updated"), ("delete", "deleted"))])


def recent(log: DataFrame, operation: str, limit: int) -> DataFrame:
    """The newest changes of a kind."""
    return log.filter(F.col("operation") == operation).orderBy(F.desc("change_id")).limit(limit)


def file_name(species: Column, month: Column, sequence: Column, number: Column, extension: str = "jpg") -> Column:
    """Initials of up to four words, year and month, sequence, number: ``ab202401-01-1.jpg``."""
    initials = F.array_join(F.slice(F.transform(F.filter(F.split(slug(species), "_"), lambda p: p != ""), lambda p: F.substring(p, 1, 1)), 1, 4), "")
    padded = F.when(F.length(sequence.cast("string")) < 2, F.lpad(sequence.cast("string"), 2, "0")).otherwise(sequence.cast("string"))
    return F.concat(initials, month, F.lit("-"), padded, F.lit("-"), number.cast("string"), F.lit("." + extension))


def folder_stats(paths: DataFrame, path: str) -> DataFrame:
    """(folder, source, images, segmented) of ``.../<source>/<folder>/<name>.<jpg or png>``."""
    part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/[^/]+[.]([^./]+)$", i)
    return paths.groupBy(part(2).alias("folder"), part(1).alias("source")).agg(F.count_if(part(3) == "jpg").alias("images"), F.count_if(part(3) == "png").alias("segmented"))


def broken_rules(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, rule) for every rule (a condition in SQL) that a row breaks; null passes, as in a table's constraints."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(c), F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def numbered(rows: DataFrame, key: str, start: int = 0, width: int = 1 << 16) -> DataFrame:
    """rows with slot, from start on in the order of key (a whole number). Slots are counted in ranges of width keys, so
    no task sorts all rows; what one task orders are the counts of ranges."""
    x = rows.withColumn("_range", F.floor(F.col(key) / width))
    counts = x.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return x.withColumn("_at", at).join(before, "_range").withColumn("slot", (F.col("_before") + F.col("_at") - 1 + start).cast("long")).drop("_range", "_at", "_before")


def appended(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """index (key, v, slot) and the rows of new that it lacks, which get the next slots; those it has stay as they are."""
    last = index.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]
    return index.unionByName(numbered(new.join(index.select(key), key, "left_anti"), key, last).select(index.columns))


def sync_counts(items: DataFrame, indexed: DataFrame, broken: DataFrame, key: str) -> DataFrame:
    """(total, indexed, missing, added, failed): what synchronising finds and does; broken: keys without a vector."""
    x = items.select(key).join(indexed.select(key, F.lit(True).alias("has")), key, "left").join(broken.select(key, F.lit(True).alias("bad")), key, "left")
    has, bad = F.coalesce("has", F.lit(False)), F.coalesce("bad", F.lit(False))
    return x.agg(F.count("*").alias("total"), F.count_if(has).alias("indexed"), F.count_if(~has).alias("missing"), F.count_if(~has & ~bad).alias("added"), F.count_if(~has & bad).alias("failed"))


def record(known: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """known and new rows, which get the next ids in the order of a column."""
    last = known.agg(F.coalesce(F.max(key) + 1, F.lit(0))).first()[0]
    return known.unionByName(numbered(new, order, last).withColumnRenamed("slot", key).select(known.columns))


def delete_items(gone: DataFrame, stores: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """What is left in each store (with the column key) without the keys of gone."""
    keys = gone.select(key).distinct()
    return {name: store.join(keys, key, "left_anti") for name, store in stores.items()}


def ingest(new: DataFrame, vectors: DataFrame, known: DataFrame, index: DataFrame, key: str, reset: bool = False, skip_known: bool = True, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, index, counts): new rows that have a vector are stored and indexed, with the next slots.

    reset starts from nothing; skip_known leaves known rows as they are, otherwise they are replaced (their slot stays);
    limit takes the first rows by key. counts is (read, known, failed, added, indexed); failed: rows without a vector.
    """
    if reset:
        known, index = known.filter("false"), index.filter("false")
    new = new.dropDuplicates([key]) if limit is None else new.dropDuplicates([key]).orderBy(key).limit(limit)
    x = new.join(known.select(key, F.lit(True).alias("_old")), key, "left").join(vectors.select(key, F.lit(True).alias("_has")), key, "left")
    fresh = x.filter("_old IS NULL AND _has").drop("_old", "_has")
    replaced = x.filter("_old").drop("_old", "_has")
    items = (known if skip_known else upsert(known, replaced.select(known.columns), key)).unionByName(fresh.select(known.columns))
    all_ = appended(index, vectors.join(fresh.select(key), key, "left_semi"), key)
    old, has = F.coalesce("_old", F.lit(False)), F.coalesce("_has", F.lit(False))
    n = x.agg(F.count("*").alias("read"), F.count_if(old).alias("known"), F.count_if(~old & ~has).alias("failed"), F.count_if(~old & has).alias("added"))
    return items, all_, n.crossJoin(all_.agg(F.count("*").alias("indexed")))  # one row each


def index_report(index: DataFrame, unit: Column, normalised: dict[str, bool]) -> DataFrame:
    """(metric, vectors, dimensions, units, fits): whether the vectors (v) are of the length that each metric's index has.
    unit says whether a row's vector has length 1; a metric that takes vectors as they are doesn't fit one of units only."""
    n = index.agg(F.count("*").alias("vectors"), F.max(F.size("v")).alias("dimensions"), F.count_if(unit).alias("units"))
    kinds = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(u).alias("normalised")) for m, u in normalised.items()])
    x = n.withColumn("k", F.explode(kinds))
    return x.select("k.metric", "vectors", "dimensions", "units", ((F.col("units") == F.col("vectors")) == F.col("k.normalised")).alias("fits"))


def folders(species: DataFrame, name: str, files: DataFrame, path: str) -> DataFrame:
    """(folder, here): the folder of each species, and whether a file is in it already."""
    there = files.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"), F.lit(True).alias("_there")).distinct()
    return species.select(slug(F.col(name)).alias("folder")).distinct().join(there, "folder", "left").select("folder", F.coalesce("_there", F.lit(False)).alias("here"))


def in_buffers(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with the number of the buffer they fill, size rows each; the last one is flushed with what there is."""
    return numbered(rows, key).withColumn("buffer", F.floor(F.col("slot") / size).cast("long")).drop("slot")


def merged(old: Column, new: Column) -> Column:
    """A map of parameters with those of another on top."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
