"""Streaming helpers for functions over Arrow batches: texts come in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken apart at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 21


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(slice of a batch, its texts as UTF-8; null is empty)."""
    for batch in batches:
        data = batch.column(column).cast(pa.large_binary())
        each = np.asarray(pa.compute.coalesce(pa.compute.binary_length(data), pa.scalar(0, pa.int64()))) if batch.num_rows else np.zeros(0, np.int64)
        ends, at = np.cumsum(each), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at), [x or b"" for x in data.slice(at, to - at).to_pylist()]
            at = to


#: Bytes at once while words are hashed.
_PIECE = 1 << 22
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
_LETTERS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes that end a word of letters, digits and underscores of ASCII; what UTF-8 has above that counts as letters, but for its punctuation.
NOT_ALNUM = ~np.isin(np.arange(256), [*b"0123456789abcdefghijklmnopqrstuvwxyz_", *range(0x80, 0x100)])
FOLDED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))


class Words:
    """The words of several UTF-8 texts: 64-bit hashes, and where they are in the joined texts.

    gap: which bytes are between words. A-Z count as a-z. Everything is vectorised: no word becomes an object.
    Without hashed, only the places are found.
    """

    def __init__(self, texts: list[bytes], gap: np.ndarray = BLANK, hashed: bool = True) -> None:
        self.joined = b" ".join(texts)
        buf = np.frombuffer(self.joined, np.uint8)
        out = gap[buf]
        if gap is NOT_ALNUM and len(buf) > 2:
            c2 = np.flatnonzero(buf[:-1] == 0xC2)
            c2 = c2[buf[c2 + 1] < 0xC0]
            e2 = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x80))
            out[np.concatenate([c2, c2 + 1, e2, e2 + 1, e2 + 2])] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[True], out, [True]]).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        size = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(size + 1) - size - 1
        self.firsts = np.searchsorted(self.starts, begins)
        self.counts = np.diff(np.append(self.firsts, len(self.starts)))
        if not hashed:
            return
        self.hashes = np.zeros(len(self.starts), np.uint64)
        letters, at = _LETTERS[FOLDED], 0
        while at < len(self.starts):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + _PIECE, "right")))
            s, n = self.starts[at:to], self.ends[at:to] - self.starts[at:to]
            first = np.cumsum(n) - n
            inside = np.arange(int(n.sum())) - np.repeat(first, n)
            bytes_ = buf[inside + np.repeat(s, n)]
            self.hashes[at:to] = np.add.reduceat(letters[bytes_] * _POWERS[inside & 0xFFFF], first) + n.astype(np.uint64)
            at = to
        self.hashes = mix64(self.hashes)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))
