"""Media columns: content-defined chunking, chunk digests deduplicated by joins, media rebuilt from chunk lists.

A medium is cut where a rolling gear hash over the last 32 bytes has its top bits zero, between MIN and MAX bytes
after the last cut, so equal passages give equal chunks wherever they are. Chunks are known by their SHA-256. Only
digests move to find which chunks occur more than once: these are stored once, in the row of the medium that has them
first. The store holds, for each distinct medium, the ordered list of chunk digests and sizes, the chunks of its own in
one piece, and the shared chunks that it keeps. Reading back joins shared chunks to the lists that name them, puts the
chunks together in order and verifies every digest and the medium's. Media without shared chunks and without copies,
most of them, are written and read in place, and later copies of a medium aren't moved at all: two Bloom filters of
bounded size tell them apart by key, and what they let through wrongly takes the join and comes out the same.

The medium of a text is a grey picture in binary PGM, 64 samples of 8 bits in a row: UTF-8, then zeros up to a positive
multiple of 64. Media are known by their SHA-256, chunks by its first half.

Edge cases: null and empty texts are 64 zeros; equal texts share one medium; null ids are ids like others, and rows with
one id but several texts have a medium each; a chunk that occurs twice in one medium counts as shared; an empty table
gives an empty result. A medium that doesn't verify raises. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm import bloom
from sparkweave.llm.arrow import slices
from sparkweave.llm.common import stage_table

WIDTH = 64
MIN, MAX, BITS = 256, 8192, 10
_GEAR = np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def encode(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode(medium: bytes) -> bytes:
    kind, shape, most, samples = medium.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or most != b"255" or width * height != len(samples):
        raise ValueError("not a medium of this module")
    return samples


def gear(buf: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: sum of gear[b[i - k]] << k over the last 32 bytes, by doubling."""
    s = _GEAR[buf]
    for w in (1, 2, 4, 8, 16):
        add = s[:-w] << np.uint32(w) if len(s) > w else s[:0]
        s = s.copy()
        s[w:] += add
    return s


def cuts(media: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each medium. MIN exceeds the hash's reach, so what is before a medium has no effect."""
    joined = np.frombuffer(b"".join(media), np.uint8)
    at = np.flatnonzero(gear(joined) >> np.uint32(32 - BITS) == 0) + 1
    out, base = [], 0
    for m in media:
        mine = at[np.searchsorted(at, base, "right") : np.searchsorted(at, base + len(m), "right")] - base
        ends, last, i = [], 0, 0
        mine = mine.tolist()
        while last < len(m):
            while i < len(mine) and mine[i] < last + MIN:
                i += 1
            last = min(len(m), last + MAX, mine[i] if i < len(mine) else len(m))
            ends.append(last)
        out.append(ends)
        base += len(m)
    return out


def chunks(media: list[bytes]) -> list[tuple[bytes, list[bytes], list[bytes]]]:
    """(SHA-256 of the medium, its chunks' digests, its chunks)."""
    out = []
    for m, ends in zip(media, cuts(media), strict=True):
        parts = [m[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        out.append((hashlib.sha256(m).digest(), [hashlib.sha256(p).digest() for p in parts], parts))
    return out


def _index(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        got = chunks([encode(payload_of(t)) for t in texts])
        yield pa.RecordBatch.from_arrays([part.column(key), pa.array([len(t) for t in texts], pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.list_(pa.binary()))], names=[key, "n_bytes", "medium", "digests"])


#: sizes: of all chunks; blob: those that nothing else has, in order, compressed; mine: shared ones that are kept here.
STORE = "medium binary, digests array<binary>, sizes array<int>, blob binary, away array<int>, mine array<struct<at: int, bytes: binary>>"
_STORE = pa.schema([("medium", pa.binary()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("blob", pa.binary()), ("away", pa.list_(pa.int32())), ("mine", pa.list_(pa.struct([("at", pa.int32()), ("bytes", pa.binary())])))])


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor().compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _store_row(medium: bytes, digests: list[bytes], parts: list[bytes], shared: set[int], mine: list[int]) -> dict:
    return {"medium": medium, "digests": digests, "sizes": [len(p) for p in parts], "blob": _squeeze(b"".join(p for i, p in enumerate(parts) if i not in shared)), "away": sorted(shared - set(mine)), "mine": [{"at": i, "bytes": _squeeze(parts[i])} for i in mine]}


def _store_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        yield pa.RecordBatch.from_pylist([_store_row(*g, set(), []) for g in chunks([encode(payload_of(t)) for t in texts])], schema=_STORE)


def _named(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        yield pa.RecordBatch.from_arrays([part.column(key), pa.array([hashlib.sha256(encode(payload_of(t))).digest() for t in texts], pa.binary()), pa.array([_squeeze(t) for t in texts], pa.binary())], names=[key, "name", "text"])


def _store_special(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the store: the chunk that others share stays in the row that has it first (mine)."""
    for part, texts in slices(batches):
        got = chunks([encode(payload_of(_open(t))) for t in texts])
        rows = [_store_row(*g, set(shared or ()), mine or []) for g, shared, mine in zip(got, part.column("shared").to_pylist(), part.column("mine").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=_STORE)


def plan(index: DataFrame, key: str) -> DataFrame:
    """(medium, owner, shared, mine) of the media that have copies or shared chunks. owner: least key that has it;
    shared: places of the chunks that come up elsewhere too, mine: of those that this medium keeps."""
    ids = F.transform("digests", lambda d: F.substring(d, 1, 16))
    media = index.select(key, "medium", ids.alias("ids")).groupBy("medium").agg(F.min(key).alias("owner"), F.count("*").alias("copies"), F.first("ids").alias("ids"))
    media = stage_table(media, "media-distinct")
    each = media.select("medium", F.xxhash64("medium").alias("m"), F.posexplode("ids").alias("at", "id"))
    several = each.groupBy("id").agg(F.count("*").alias("n"), F.min("m").alias("first")).filter("n > 1").select("id", "first")
    several = stage_table(several, "media-shared")
    maybe = bloom.prefilter(several.select("id"), several.count())
    where = each.filter(maybe.passes(F.col("id"))).join(several, "id")
    own = F.sort_array(F.collect_list(F.when(F.col("m") == F.col("first"), F.struct("id", "at"))))
    roles = where.groupBy("medium").agg(F.sort_array(F.collect_list("at")).alias("shared"), own.alias("own"))
    once = F.filter("own", lambda x, i: (i == 0) | (x["id"] != F.get(F.col("own"), i - 1)["id"]))
    roles = roles.select("medium", "shared", F.transform(once, lambda x: x["at"]).alias("mine"))
    got = media.select("medium", "owner", "copies").join(roles, "medium", "left").filter("copies > 1 OR shared IS NOT NULL")
    return stage_table(got.select("medium", "owner", "shared", "mine"), "media-plan")


def store(docs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Write the chunk store of all media of docs (key, text) and return it as read back."""
    planned = plan(index, key)
    owners = planned.select("medium", "owner", F.lit(True).alias("planned"))
    here = F.col(key).eqNullSafe(F.col("owner"))
    role = F.when(F.col("planned").isNull(), "alone").when(here, "owner").otherwise("later")
    place = stage_table(index.select(key, "medium").join(owners, "medium", "left").select(key, role.alias("role")).distinct(), "media-place")
    count = {r.role: r["count"] for r in place.groupBy("role").count().collect()}
    of = lambda *roles: bloom.prefilter(place.filter(F.col("role").isin(*roles)).select(key), sum(count.get(r, 0) for r in roles)).passes(F.col(key))
    special, kept = of("owner", "later"), of("owner", "alone")
    alone = docs.filter(~special).select("text").mapInArrow(_store_alone, STORE)
    kind = docs.schema[key].dataType.simpleString()
    named = docs.filter(special & kept).mapInArrow(lambda b: _named(key, b), f"`{key}` {kind}, name binary, text binary")
    met = named.join(planned.withColumn("planned", F.lit(True)), F.col("name") == F.col("medium"), "left").filter(F.col("planned").isNull() | here)
    met = met.dropDuplicates(["name"]).select("text", "shared", "mine")
    return stage_table(alone.unionByName(met.mapInArrow(_store_special, STORE)), "media-store")


def feature_of(payload: bytes) -> str:
    """Size, mean, deviation, entropy and the most frequent sample of a grey picture."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n = len(payload)
    p = counts[counts > 0] / n
    mean = float((counts * np.arange(256)).sum() / n)
    var = float((counts * np.square(np.arange(256) - mean)).sum() / n)
    return f"{WIDTH}x{n // WIDTH};mean={mean:.3f};dev={var**0.5:.3f};entropy={float(-(p * np.log2(p)).sum()):.3f};mode={int(counts.argmax())}"


FEATURES = "medium binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuild, verify, decode. fetched: (at, bytes) of the shared chunks that other rows keep, if the medium has any."""
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            part, rows = batch.slice(start, 128), []
            for r in part.to_pylist():
                blob, at, parts = _open(r["blob"]), 0, []
                other = {x["at"]: _open(x["bytes"]) for x in [*r["mine"], *(r.get("fetched") or ())]}
                away = set(r["away"])
                for i, n in enumerate(r["sizes"]):
                    inside = i not in other and i not in away
                    parts.append(blob[at : at + n] if inside else other.get(i, b""))
                    at += n if inside else 0
                if any(hashlib.sha256(p).digest() != d for p, d in zip(parts, r["digests"], strict=True)):
                    raise ValueError(f"a chunk of medium {r['medium'].hex()} doesn't verify")
                medium = b"".join(parts)
                sha = hashlib.sha256(medium).digest()
                if sha != r["medium"]:
                    raise ValueError(f"medium {r['medium'].hex()} doesn't verify")
                payload = decode(medium)
                rows.append((sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(medium), sha.hex(), feature_of(payload)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])


def read_back(stored: DataFrame) -> DataFrame:
    """FEATURES of every medium in the store."""
    whole, apart = stored.filter("size(away) = 0"), stored.filter("size(away) > 0")
    digest = lambda at: F.get("digests", at).alias("digest")
    wanted = apart.select("medium", "digests", F.explode("away").alias("at")).select("medium", "at", digest(F.col("at")))
    shared = stored.filter("size(mine) > 0").select("digests", F.explode("mine").alias("x")).select(digest(F.col("x.at")), "x.bytes")
    fetched = wanted.join(shared, "digest").groupBy("medium").agg(F.collect_list(F.struct("at", "bytes")).alias("fetched"))
    return whole.mapInArrow(_read, FEATURES).unionByName(apart.join(fetched, "medium", "left").mapInArrow(_read, FEATURES))


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), read back from the store."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    index = stage_table(rows.mapInArrow(lambda b: _index(key, b), f"`{key}` {kind}, n_bytes bigint, medium binary, digests array<binary>"), "media-index")
    features = stage_table(read_back(store(rows, index, key)), "media-features")
    return index.select(key, "n_bytes", "medium").join(features, "medium").drop("medium")
