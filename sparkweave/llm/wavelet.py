"""Token ids in a wavelet matrix for each shard: one compressed file that gives access, counts and occurrences.

A shard holds the ids of consecutive documents. Its alphabet is made dense, and the ids are stored as bit planes from
the highest bit down; after each plane the sequence is parted stably by that bit, zeros first. A plane is cut into blocks
of BLOCK bits, each compressed by itself where that makes it smaller, and a directory has the ones before each block and
where it is in the file. So rank opens one block, and select finds its block in the directory by binary search: access,
counts and single occurrences touch a block or two of each plane, in a file that stays compressed in memory. Rank gives
any id by position and counts of an id before a position; select gives where the k-th occurrence is. The file has the
alphabet, the documents' ids and the planes; where documents end is found by the occurrences of the end id, if that is
in no document (counts are stored otherwise).

Documents are range-partitioned and sorted by id; each task writes shards of about SHARD_TOKENS ids in order, as rows
of a Parquet table in the shared folder, so any store that Spark writes will do. Ranges follow from the bytes of the
table, and equal ids are dealt further by the hash of their text. A text longer than SHARD_TOKENS makes its
own shard. Texts are encoded by the tokenizers library; as its pre-tokenizer always splits before a blank that is
followed by a non-blank, units of one blank or line end and a word are encoded once and remembered, in bounded memory; texts
with runs of white space are encoded whole.

Edge cases: null and empty texts have only the end id; equal document ids stay together, in order of their text's hash;
repeated rows are encoded each; a null document id counts as the least and is returned; an empty table gives an empty
result. Extra columns are not carried.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.arrow import _LETTERS, _POWERS, mix64, slices
from sparkweave.llm.common import size_in_bytes, stage_table

MAGIC = b"WVLT0002"
SHARD_TOKENS = 1 << 20
#: Bits of a block, and how many opened blocks are kept.
BLOCK, OPEN = 1 << 17, 128
#: Of the table's files, for each range that a task writes.
RANGE_BYTES = 1 << 24
#: Bytes of text whose words are told apart at once.
TEXT_BYTES = 1 << 23
END = 2
NONE = -(1 << 63)


_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _packed(data: bytes) -> tuple[bool, bytes]:
    small = _COMPRESS(data)
    return (True, small) if len(small) < len(data) else (False, data)


def _pack(data: bytes) -> bytes:
    small, data = _packed(data)
    return struct.pack("<?q", small, len(data)) + data


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def bytes(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def section(self) -> bytes:
        packed, n = self.take("<?q")
        part = self.bytes(n)
        return _DECOMPRESS(part) if packed else part


def _plane(bits: np.ndarray) -> bytes:
    """A directory (ones before each block, its end among the blocks' bytes, whether it is compressed) and the blocks."""
    raw = np.packbits(bits, bitorder="little").tobytes()
    blocks = [_packed(raw[a : a + BLOCK // 8]) for a in range(0, len(raw), BLOCK // 8)]
    ones = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
    ends = np.cumsum([len(x) for _, x in blocks], dtype=np.int64)
    small = np.array([x for x, _ in blocks], bool)
    return b"".join([(np.cumsum(ones) - ones).astype("<i8").tobytes(), ends.astype("<i8").tobytes(), small.tobytes(), struct.pack("<q", int(ones.sum())), *(x for _, x in blocks)])


class Plane:
    """One plane of a file: its blocks stay compressed until they are asked for."""

    def __init__(self, r: _Reader, n: int, cache: dict) -> None:
        k = -(-n // BLOCK)
        self.n, self.cache = n, cache
        self.before, self.ends = np.frombuffer(r.bytes(8 * k), "<i8"), np.frombuffer(r.bytes(8 * k), "<i8")
        self.small = np.frombuffer(r.bytes(k), bool)
        (self.ones,) = r.take("<q")
        self.data, self.at = r.data, r.at
        r.at += int(self.ends[-1]) if k else 0
        #: Zeros before each block.
        self.clear = np.arange(k) * BLOCK - self.before

    def _raw(self, b: int) -> bytes:
        part = self.data[self.at + (int(self.ends[b - 1]) if b else 0) : self.at + int(self.ends[b])]
        return _DECOMPRESS(part) if self.small[b] else part

    def block(self, b: int) -> np.ndarray:
        """Bits of a block; at most OPEN blocks of a file are kept."""
        name = (self.at, b)
        if name not in self.cache:
            if len(self.cache) >= OPEN:
                self.cache.pop(next(iter(self.cache)))
            self.cache[name] = np.unpackbits(np.frombuffer(self._raw(b), np.uint8), bitorder="little").view(bool)[: self.n - b * BLOCK]
        return self.cache[name]

    def bits(self) -> np.ndarray:
        raw = b"".join(self._raw(b) for b in range(len(self.ends)))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, i: int) -> bool:
        return bool(self.block(i // BLOCK)[i % BLOCK])

    def rank(self, i: int) -> int:
        """Ones before i."""
        if i >= self.n:
            return self.ones
        b, rest = divmod(i, BLOCK)
        return int(self.before[b]) + (int(np.count_nonzero(self.block(b)[:rest])) if rest else 0)

    def select(self, bit: bool, k: int) -> int:
        """Where the k-th such bit is."""
        before = self.before if bit else self.clear
        b = int(np.searchsorted(before, k, "right")) - 1
        block = self.block(b)
        return b * BLOCK + int(np.flatnonzero(block if bit else ~block)[k - int(before[b])])


def build(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray, end: int | None = None) -> bytes:
    """The file of one shard. ids: of all its documents; keys, counts: one for each document; end: closes each, if any."""
    ids, counts = np.asarray(ids, np.uint32), np.asarray(counts, "<i8")
    top = int(ids.max()) + 1 if len(ids) else 1
    there = np.zeros(top, bool)
    there[ids] = True
    alphabet = np.flatnonzero(there).astype(np.uint32)
    dense = np.zeros(top, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    dense[alphabet] = np.arange(len(alphabet))
    a = dense[ids]
    levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
    closed = end is not None and np.array_equal(np.flatnonzero(ids == end) + 1, np.cumsum(counts))
    out = [MAGIC, struct.pack("<qqiq", len(ids), len(keys), levels, end if closed else -1), _pack(alphabet.astype("<u4").tobytes()), _pack(np.asarray(keys, "<i8").tobytes()), _pack(b"" if closed else counts.tobytes())]
    for level in range(levels - 1, -1, -1):
        bit = (a & a.dtype.type(1 << level)) != 0
        out.append(_plane(bit))
        if level:
            a = np.concatenate([a.take(np.flatnonzero(~bit)), a.take(np.flatnonzero(bit))])
    return b"".join(out)


class WaveletMatrix:
    """A shard's file, opened."""

    def __init__(self, data: bytes) -> None:
        r = _Reader(data)
        if r.data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        r.at = 8
        self.n, docs, self.levels, self.end = r.take("<qqiq")
        self.alphabet = np.frombuffer(r.section(), "<u4")
        self.keys, counts = np.frombuffer(r.section(), "<i8"), np.frombuffer(r.section(), "<i8")
        cache: dict = {}
        self.planes = [Plane(r, self.n, cache) for _ in range(self.levels)]
        self.zeros = [self.n - p.ones for p in self.planes]
        self._bits: list[np.ndarray] | None = None
        self._counts = counts
        assert len(self.keys) == docs

    def whole(self) -> list[np.ndarray]:
        """All planes' bits, for work on all ids."""
        if self._bits is None:
            self._bits = [p.bits() for p in self.planes]
        return self._bits

    def ids(self) -> np.ndarray:
        """The whole sequence."""
        return self.documents()[0]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(the whole sequence, ids of each document with its end id): planes are gone through once, from the lowest up.
        Documents end where the end id's occurrences are selected."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        end = self._code(self.end) if self.end >= 0 else None
        at = np.zeros(0, np.int64) if end is None else np.arange(*self._range(end, self.n))
        low = np.zeros(self.n, kind)
        for level in range(self.levels):
            p, z = self.planes[-1 - level], self.zeros[-1 - level]
            bit = p.bits()
            clear, set_ = np.flatnonzero(~bit), np.flatnonzero(bit)
            up = np.empty(self.n, kind)
            up[clear] = low[:z]
            up[set_] = low[z:] | kind(1 << level)
            low = up
            if end is not None:
                at = set_[at - z] if end >> level & 1 else clear[at]
        counts = np.diff(at + 1, prepend=0) if end is not None else self._counts
        return (self.alphabet[low] if self.n else np.zeros(0, np.uint32)), counts

    def access(self, i: int) -> int:
        """The id at position i."""
        code = 0
        for p, z in zip(self.planes, self.zeros, strict=True):
            bit, before = p.get(i), p.rank(i)
            code = code << 1 | bit
            i = z + before if bit else i - before
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        c = int(np.searchsorted(self.alphabet, token))
        return c if c < len(self.alphabet) and self.alphabet[c] == token else None

    def _range(self, code: int, i: int) -> tuple[int, int]:
        """Where the code's run begins after all planes, and how far position i has come in it."""
        lo, hi = 0, i
        for level, (p, z) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = p.rank(lo), p.rank(hi)
            lo, hi = (z + a, z + b) if code >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        c = self._code(token)
        if c is None:
            return 0
        lo, hi = self._range(c, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k, from 0."""
        c = self._code(token)
        if c is None or not 0 <= k < self.count(token):
            raise IndexError("no such occurrence")
        i = self._range(c, 0)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = bool(c >> (self.levels - 1 - level) & 1)
            i = self.planes[level].select(bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of token: one by one while they are few, else all at once on whole planes."""
        c, n = self._code(token), self.count(token)
        if n <= 32:
            return np.array([self.select(token, k) for k in range(n)], np.int64)
        at = self._range(c, 0)[0] + np.arange(n)
        for level in range(self.levels - 1, -1, -1):
            bits = self.whole()[level]
            bit = bool(c >> (self.levels - 1 - level) & 1)
            at = np.flatnonzero(bits if bit else ~bits)[at - self.zeros[level] if bit else at]
        return at


_OTHER_SPACE = re.compile(r"[^\S \n]")


class Encoder:
    """Ids of texts by a tokenizer's file, the end id included.

    What is remembered are units' texts as one Arrow array, their hashes in order, and their ids in one array: no unit is
    an object of its own, which would take three times the memory. A unit that a hash finds is compared as text."""

    UNITS = 1_500_000
    #: Bytes of remembered units' texts; units are long in some corpora.
    UNIT_BYTES = 1 << 25
    #: Units whose ids are gathered at once.
    GATHER = 1 << 17

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        (blank,) = self.tokenizer.encode(" ", add_special_tokens=False).tokens
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Whether a token begins with a blank; inside a word none does.
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(blank) for i in range(size)])
        #: Whether a text has no white space but blanks and line ends.
        self.plain = lambda t: not _OTHER_SPACE.search(t)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.first = np.zeros(1 << 20, np.int32)
        self.used = np.zeros(1 << 20, np.int32)
        self.n, self.full = 0, 0
        #: Units in order, and which unit has which hash, by hash.
        self.units = pa.array(["\0\0"], pa.large_string())
        self.hashes, self.of = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: The end id is the first unit, and stays it; no text has its name.
        self._keep(np.array([END], np.uint32), np.array([1]))

    def _forget(self) -> None:
        """Keep the units that were met in most slices: at most half of UNITS and UNIT_BYTES."""
        used = self.used[: self.n]
        bytes_ = np.asarray(pa.compute.binary_length(self.units))
        used[0], least = np.iinfo(np.int32).max, 2
        while (used >= least).sum() > self.UNITS // 2 or bytes_[1:][used[1:] >= least].sum() > self.UNIT_BYTES // 2:
            least += 1
        kept = np.flatnonzero(used >= least)
        size = np.diff(self.first[: self.n + 1])[kept]
        ends = np.cumsum(size)
        self.full = int(ends[-1])
        ids = self.ids[np.arange(self.full) + np.repeat(self.first[kept] - (ends - size), size)]
        self.ids = np.zeros(max(1 << 20, self.full * 3 // 2), np.uint32)
        self.ids[: self.full] = ids
        self.first[1 : len(kept) + 1] = ends
        self.used[:] = 0
        now = np.full(self.n, -1, np.int32)
        now[kept] = np.arange(len(kept))
        of = now[self.of]
        self.hashes, self.of = self.hashes[of >= 0], of[of >= 0]
        self.units, self.n = self.units.take(pa.array(kept)), len(kept)

    def _learn(self, units: list[str]) -> np.ndarray:
        """Encode what is new; returns the units' numbers. A unit is a word after a blank; with "\n" in front, one after a
        line's end; with "\0", one that begins a text. Many are encoded in one text: words between blanks, the others as
        lines."""
        kinds: dict[str, list[int]] = {"": [], "\n": [], "\0": []}
        for i, u in enumerate(units):
            kinds[u[0] if u and u[0] in "\n\0" else ""].append(i)
        number = np.zeros(len(units), np.int32)
        for front, mine in kinds.items():
            bare = [units[i][1:] for i in mine] if front else [units[i] for i in mine]
            if " ".join(bare).split() != bare:
                odd = [i for i in range(len(mine)) if bare[i].split() != [bare[i]]]
                for i, e in zip(odd, self.tokenizer.encode_batch_fast([bare[i] if front else " " + bare[i] for i in odd], add_special_tokens=False), strict=True):
                    ids = np.array([self.newline] * (front == "\n") + e.ids, np.uint32)
                    number[mine[i]] = self._keep(ids, np.array([len(ids)]))
                mine = [i for i, w in zip(mine, bare, strict=True) if w.split() == [w]]
                bare = [w for w in bare if w.split() == [w]]
            gap = "\n" if front else " "
            for start in range(0, len(mine), 4096):
                got = np.array(self.tokenizer.encode_batch_fast([gap + gap.join(bare[start : start + 4096])], add_special_tokens=False)[0].ids, np.uint32)
                opens = got == self.newline if front else self.opens[got]
                begins = np.flatnonzero(opens)
                assert len(begins) == len(mine[start : start + 4096]) and begins[0] == 0
                ends = np.append(begins[1:], len(got))
                if front == "\0":
                    got, ends = got[~opens], ends - np.arange(1, len(ends) + 1)
                number[mine[start : start + 4096]] = self._keep(got, ends)
        return number

    def _keep(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of new units, from their ids and where each ends in them."""
        k, n = self.n, len(ends)
        while self.full + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) // 2, np.uint32)])
        while k + n + 1 > len(self.first):
            self.first, self.used = (np.concatenate([x, np.zeros(len(x) // 2, np.int32)]) for x in (self.first, self.used))
        self.ids[self.full : self.full + len(ids)] = ids
        self.first[k + 1 : k + n + 1] = self.full + ends
        self.full += len(ids)
        self.n += n
        return np.arange(k, k + n)

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """The numbers of different units; new ones are learnt."""
        hashes, number = _hashes(units), np.full(len(units), -1, np.int32)
        if len(self.hashes) and len(units):
            by_hash = np.argsort(hashes)
            at = np.minimum(np.searchsorted(self.hashes, hashes[by_hash]), len(self.hashes) - 1)
            found = self.hashes[at] == hashes[by_hash]
            mine, theirs = by_hash[found], self.of[at[found]]
            same = np.asarray(pa.compute.equal(units.take(pa.array(mine)), self.units.take(pa.array(theirs))))
            number[mine[same]] = theirs[same]
        new = np.flatnonzero(number < 0)
        if new.size:
            texts = units.take(pa.array(new))
            number[new] = self._learn(texts.to_pylist())
            self.units = pa.concat_arrays([self.units, texts.take(pa.array(np.argsort(number[new])))])
            new = new[np.argsort(hashes[new])]
            at = np.searchsorted(self.hashes, hashes[new])
            self.hashes, self.of = np.insert(self.hashes, at, hashes[new]), np.insert(self.of, at, number[new])
        return number

    def _gather(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of units in turn, where each unit ends)."""
        first = self.first[: self.n + 1]
        size = np.diff(first)[unit]
        ends = np.cumsum(size, dtype=np.int64)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for a in range(0, len(unit), self.GATHER):
            n, to = size[a : a + self.GATHER], ends[a : a + self.GATHER]
            start = int(to[0]) - int(n[0])
            at = np.repeat(first[unit[a : a + self.GATHER]] - (to - n - start).astype(np.int32), n)
            at += np.arange(len(at), dtype=np.int32)
            np.take(self.ids, at, out=ids[start : start + len(at)], mode="clip")
        return ids, ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text), each text closed by END."""
        whole, split = [], []
        n_units = np.zeros(len(texts), np.int64)
        for n, t in enumerate(texts):
            if not t or "\0" in t or "  " in t or "\n\n" in t or "\n " in t or " \n" in t or t[0].isspace() or t[-1].isspace() or not self.plain(t) and any(u[u[0] == "\n" :][:1].isspace() for u in t.replace("\n", " \n").split(" ")):
                whole.append(n)
            else:
                split.append("\0" + t)
                n_units[n] = t.count(" ") + t.count("\n") + 1
        odd = [texts[n] for n in whole]
        del texts
        if self.n > self.UNITS or self.units.nbytes - 8 * self.n > self.UNIT_BYTES:
            self._forget()
        # equal units of the slice become one before any of them becomes an object
        joined = " ".join(split)
        split = bool(split)
        joined = pa.array([joined.replace("\n", " \n")] if split else [], pa.large_string())
        coded = pa.compute.split_pattern(joined, " ").values
        del joined
        coded = coded.dictionary_encode()
        # Arrow's pool keeps what is freed, beside what comes next
        pa.default_memory_pool().release_unused()
        number = self._numbers(coded.dictionary)
        self.used[number] += 1
        upto = np.cumsum(n_units)
        unit = np.insert(number[coded.indices.to_numpy()], upto, 0)
        del coded, number
        ids, ends = self._gather(unit)
        counts = np.diff(ends[upto + np.arange(len(upto))], prepend=0)
        del unit, ends
        pa.default_memory_pool().release_unused()
        alone = dict(zip(whole, (e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)), strict=True)) if whole else {}
        if not alone:
            return ids, counts
        out, start = [], 0
        for n, c in enumerate(counts.tolist()):
            if n in alone:
                out.append(np.asarray(alone[n], np.uint32))
                counts[n] += len(alone[n])
            out.append(ids[start : start + c])
            start += c
        return np.concatenate(out), counts


def _hashes(units: pa.Array) -> np.ndarray:
    """64-bit hashes of texts that aren't empty, in pieces."""
    ends = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1] if len(units) else np.zeros(1, np.int64)
    out = np.zeros(len(units), np.uint64)
    data, at = np.frombuffer(units.buffers()[2] or b"", np.uint8), 0
    while at < len(units):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 19), "right")) - 1)
        first = ends[at:to] - ends[at]
        size = np.diff(ends[at : to + 1])
        inside = np.arange(int(ends[to] - ends[at])) - np.repeat(first, size)
        out[at:to] = np.add.reduceat(_LETTERS[data[ends[at] : ends[to]]] * _POWERS[inside & 0xFFFF], first) + size.astype(np.uint64)
        at = to
    return mix64(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file: what it remembers serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


FILES = "part int, seq int, local_start bigint, n_docs bigint, n_tokens bigint, data binary"


def _write(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder, part = encoder(path), TaskContext.get().partitionId()
    seq, before = 0, 0
    ids: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        nonlocal seq, before
        all_ids, all_keys, all_counts = np.concatenate(ids), np.concatenate(keys), np.concatenate(counts)
        row = {"part": part, "seq": seq, "local_start": before, "n_docs": len(all_keys), "n_tokens": len(all_ids), "data": build(all_ids, all_keys, all_counts, END)}
        seq, before = seq + 1, before + len(all_ids)
        for x in (ids, keys, counts):
            x.clear()
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("local_start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())]))

    for rows, texts in slices(batches, size=TEXT_BYTES):
        got, n = coder.encode([t.decode("utf-8", "replace") for t in texts])
        names, ends, at = np.asarray(rows.column("key").fill_null(NONE)), np.cumsum(n), 0
        while at < len(n):
            before_at = int(ends[at - 1]) if at else 0
            to = min(len(n), int(np.searchsorted(ends, before_at + SHARD_TOKENS - sum(map(len, ids)))) + 1)
            ids.append(got[before_at : ends[to - 1]].copy())
            counts.append(n[at:to])
            keys.append(names[at:to])
            at = to
            if sum(map(len, ids)) >= SHARD_TOKENS:
                yield flush()
        del got  # what is left is a copy, beside the next slice
    if ids:
        yield flush()


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, write the shards' files in order of key, and return their table (FILES) as read back."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    n = max(1, -(-size_in_bytes(docs, text) // RANGE_BYTES))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stage_table(ordered.select("key", "text").mapInArrow(lambda b: _write(path, b), FILES), "token-shards")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column("base").to_pylist(), batch.column("data"), strict=True):
            w = WaveletMatrix(data.as_py())
            ids, counts = w.documents()
            ids, ends = ids.astype("<u4"), np.cumsum(counts)
            starts = ends - counts
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(w.keys, mask=w.keys == NONE), pa.array(starts + base), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files."""
    from pyspark.sql import Window

    # a row for each task that wrote: bounded by the number of partitions
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("part_start"))
    placed = files.join(F.broadcast(bases), "part").select("data", (F.col("part_start") + F.col("local_start")).alias("base"))
    return placed.mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
