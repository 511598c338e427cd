"""Benchmark decontamination: CGK random walks, repeated bit-sampling LSH over windows, exact edit verification.

The CGK embedding walks over a sequence of characters: step i writes the character under the cursor and moves on if
bit i of that character's random bits is set. Sequences at a small edit distance agree on most steps, so sampled steps
of the embedding (bit sampling, for Hamming distance) collide with good probability; each repetition has its own walk
and its own steps. An item's window is covered by walks from each of its words, and documents are walked from every
word, so that wherever an item is whole over the length of a walk, they meet. The repetitions follow from the recall
that is aimed at: the fewer walks fit into an item, the more of them are repeated. Items that less than FEW walks fit
into are found without loss by pieces: with d edits allowed, one of d + 1 pieces is as it was. What collides is
compared with the part of the item around it, for many candidates at once, and then verified: the least edit distance
in characters (bit-parallel, Sellers' free ends) between the item and the words around the place must be at most
(1 - similarity) of the item's length. A copy whose edits leave no start with a walk's length alike (such as one edit
in every fifth character) isn't met.

Documents are only scanned: nothing is shuffled, copies and long texts cost what their length costs. The benchmark
goes to the tasks in blocks of BLOCK items, one scan for each block.

Words are runs of letters, digits and underscores in lower case (beyond ASCII all but punctuation counts as letters).
Edge cases: null or empty texts and items without a word match nothing; repeated rows are reported each; repeated items
too; ids of items are of any type, also null; a document with several hits of an item gives its best (least distance,
then first place). Items that are found by pieces match whole words only. Extra columns are not carried by find_leaks,
and all by drop_leaks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkweave.llm.arrow import NOT_ALNUM, Words, mix64, slices

SIMILARITY = 0.8
BLOCK = 20_000
#: Share of the near copies with the most edits, at random places, that the search is to find.
TARGET = 0.97
#: Items with fewer starts of walks are found by pieces; their parts are they themselves, so nothing is lost.
FEW = 8
#: Characters of an item's part that is compared before the item, its edits as a share, and how far it may be off.
PART, PART_EDITS, SLACK = 64, 0.34, 16
#: Places that count as one; classes that characters are compared by, before they are compared themselves.
GRAIN, CLASSES = 16, 64
#: Starts that are walked from at once, candidates that are compared at once: what they need stays in a core's cache.
RUN, COMPARED = 1 << 12, 1 << 10


@dataclass(frozen=True)
class Walk:
    """Up to steps steps, of which samples are compared, over about room characters; survives: how often a walk comes
    out alike at the most edits."""

    steps: int
    samples: int
    room: int
    survives: float
    seed: int

    def repeats(self, starts: int) -> int:
        """Walks from each start that reach TARGET for an item with so many starts."""
        return math.ceil(math.log(1 - TARGET) / (starts * math.log(1 - self.survives)))

    def plan(self, n: int) -> list[Steps]:
        """The first n of the walks, which are the same whatever n is."""
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return [Steps(int(rng.integers(1, 1 << 62)), np.sort(rng.choice(self.steps, self.samples, replace=False)).tolist()) for _ in range(n)]


@dataclass
class Steps:
    """One walk: its key and the steps that are compared; by character, its value, whose bit i tells if step i moves on."""

    key: int
    sampled: list[int]

    def __post_init__(self) -> None:
        self.value = mix64(np.arange(CHARS, dtype=np.uint64) ^ np.uint64(self.key))


class Seen:
    """Which signatures may be among those given: by their first bits, of which there are more the more are given."""

    def __init__(self, sig: np.ndarray) -> None:
        bits = min(20, 6 + len(sig).bit_length())
        self.shift = np.uint64(64 - bits)
        self.low = np.zeros(1 << bits, bool)
        self.low[(sig >> self.shift).astype(np.intp)] = True

    def among(self, sig: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.low.take((sig >> self.shift).view(np.intp)))


#: Characters beyond are taken modulo this, which is what 16 bits hold.
CHARS = 1 << 16
#: survives was measured on texts of the test tables with edits in 19% of the characters: 4.7 of 42 starts.
WALK = Walk(steps=24, samples=14, room=16, survives=0.11, seed=101)


def embed(chars: np.ndarray, starts: np.ndarray, walk: Steps, halves: Seen | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which of the starts, signatures of the sampled steps, those half way, characters used) of the CGK walks from
    starts, which ascend. With halves, walks end half way whose signature isn't among them. chars: padded at the end."""
    out, last, half = [], walk.sampled[-1], walk.sampled[len(walk.sampled) // 2]
    for a in range(0, len(starts), RUN):
        at = starts[a : a + RUN]
        first, which = at[0], np.arange(a, a + len(at))
        values = walk.value.take(chars[first : at[-1] + last + 1])
        at = at - first
        sig = np.zeros(len(at), np.uint64)
        for i in range(last + 1):
            value = values.take(at)
            if i in walk.sampled:
                sig *= np.uint64(0x9E3779B97F4A7C15)
                sig += value
            if i == half:
                middle = mix64(sig)
                if halves:
                    go = halves.among(middle)
                    which, at, sig, middle, value = (x.take(go) for x in (which, at, sig, middle, value))
            if i < last:
                at += ((value >> np.uint64(i)) & np.uint64(1)).view(np.intp)
        out.append((which, mix64(sig), middle, at + first - starts.take(which) + 1))
    none = np.zeros(0, np.intp)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none.view(np.uint64), none.view(np.uint64), none)


class Plain:
    """Texts as their words, with a blank before all and one after each: string, characters as numbers, where words and
    texts begin."""

    def __init__(self, texts: list[bytes]) -> None:
        words = Words([t.decode("utf-8", "replace").lower().encode() for t in texts], NOT_ALNUM, hashed=False)
        self.firsts, self.counts = words.firsts, words.counts
        buf = np.append(np.frombuffer(words.joined, np.uint8), np.uint8(0x20))
        edges = np.zeros(len(buf), np.int8)
        edges[words.starts] += 1
        edges[words.ends] -= 1
        inside = np.cumsum(edges, dtype=np.int8) > 0
        keep = inside.copy()
        keep[words.ends] = True
        self.text = " " + np.where(inside, buf, np.uint8(0x20))[keep].tobytes().decode()
        chars = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.starts = np.flatnonzero(chars == 0x20) + 1
        self.chars = np.append(chars.astype(np.uint16), np.zeros(WALK.steps + 1, np.uint16))


def distance_in(pattern: str, text: str) -> int:
    """Least edit distance of pattern to any substring of text (Myers' bit vectors)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        d += bool(ph & top) - bool(mh & top)
        best = min(best, d)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best


def near_by(peq: np.ndarray, pattern: np.ndarray, length: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern of up to 64 characters in its column of text, in classes of characters. peq:
    by pattern, bits by class."""
    one = np.uint64(1)
    top = (length - 1).astype(np.uint64)
    pv, mv = np.full(len(pattern), ~np.uint64(0)), np.zeros(len(pattern), np.uint64)
    d = length.astype(np.int64)
    best = d.copy()
    by_class, base = peq.ravel(), pattern * peq.shape[1]
    for classes in text:
        eq = by_class.take(base + classes)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        d += ((ph >> top) & one).view(np.int64)
        d -= ((mh >> top) & one).view(np.int64)
        np.minimum(best, d, out=best)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    return best


class Index:
    """Signatures of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], similarity: float = SIMILARITY) -> None:
        plain = [(i, Plain([(t or "").encode()])) for i, t in items]
        plain = [(i, p) for i, p in plain if p.counts[0]]
        self.ids = [i for i, _ in plain]
        starts = [int((p.starts + WALK.room <= len(p.text)).sum()) for _, p in plain]
        self.repeats = [WALK.repeats(n) if n >= FEW else 0 for n in starts]
        size = [len(p.text) - 2 for _, p in plain]
        self.size = np.array(size, np.int64)
        self.allowed = [int((1 - similarity) * n + 1e-9) for n in size]
        #: What is searched for: the item, and with the blanks around it where whole words are asked for.
        self.texts = [p.text[1:-1] if n else p.text for n, (_, p) in zip(self.repeats, plain, strict=True)]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.pieces: list[tuple[str, int, int, int]] = []
        rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
        parts: list[tuple[int, int]] = []
        walks = WALK.plan(max(self.repeats, default=0))
        for k, (_, p) in enumerate(plain):
            first, n = len(parts), len(self.texts[k])
            parts += [(k, min(a, max(0, n - PART))) for a in range(0, max(1, n - PART // 2), PART // 2)]
            part_of = lambda o: min(len(parts) - 1, first + max(0, o - PART // 4) // (PART // 2))  # noqa: B023, E731
            for r, walk in enumerate(walks[: self.repeats[k]]):
                _, sig, middle, used = embed(p.chars, p.starts[:-1], walk)
                rows.setdefault(r, []).extend((int(s), k, int(o) - 1, part_of(int(o) - 1), int(m)) for s, m, o, u in zip(sig, middle, p.starts[:-1], used, strict=True) if o + u <= n + 2)
            if not self.repeats[k]:
                ends = np.linspace(0, n, self.allowed[k] + 2).astype(int).tolist()
                self.pieces += [(self.texts[k][a:b], k, a, part_of(a)) for a, b in zip(ends, ends[1:], strict=False)]
        self.walks = walks
        self.part_at = np.array([a for _, a in parts], np.int64)
        self.part_length = np.array([min(PART, len(self.texts[k])) for k, _ in parts], np.int64)
        self.peq = np.zeros((len(parts), CLASSES), np.uint64)
        for n, (k, a) in enumerate(parts):
            for i, c in enumerate(self.texts[k][a : a + PART]):
                self.peq[n, ord(c) % CLASSES] |= np.uint64(1 << i)
        self.tables = {}
        for at, got in rows.items():
            sig = np.array([g[0] for g in got], np.uint64)
            order = np.argsort(sig, kind="stable")
            halves = Seen(np.array([g[4] for g in got], np.uint64))
            self.tables[at] = (sig[order], *(np.array([g[i] for g in got], np.int64)[order] for i in (1, 2, 3)), Seen(sig), halves)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"walks": len(self.walks)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"walks": WALK.plan(state["walks"])}

    def candidates(self, docs: Plain) -> set[tuple[int, int, int]]:
        """(document, item, place of the item's first character, from the first of all texts) that may be alike."""
        found = []
        starts = docs.starts[:-1]

        def put(place: np.ndarray, item: np.ndarray, part: np.ndarray, offset: np.ndarray) -> None:
            doc = np.searchsorted(docs.firsts, np.searchsorted(starts, place, "right") - 1, "right") - 1
            found.append(np.stack([doc, item, part, (place - offset + self.length[item]) // GRAIN, place - offset], 1))

        for r, walk in enumerate(self.walks):
            if r not in self.tables:
                continue
            known, item, offset, part, seen, halves = self.tables[r]
            which, sig, *_ = embed(docs.chars, starts, walk, halves)
            maybe = seen.among(sig)
            lo, hi = np.searchsorted(known, sig[maybe], "left"), np.searchsorted(known, sig[maybe], "right")
            n = hi - lo
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            put(starts[np.repeat(which[maybe], n)], item[j], part[j], offset[j])
        for piece, k, offset, part in self.pieces:
            at = np.array(list(_places(piece, docs.text)), np.int64)
            lead = piece.startswith(" ")  # a blank that opens a piece belongs to the word after it
            put(at + lead, *(np.full(len(at), x) for x in (k, part, offset + lead)))
        out: set[tuple[int, int, int]] = set()
        if found:
            # one of those of the same part of an item on about the same diagonal
            hits = np.concatenate(found)
            hits = hits[hits[:, 0] >= 0]
            place = (hits[:, 3] << 32) | hits[:, 2]
            order = np.lexsort((hits[:, 4], hits[:, 0], place))
            fresh = np.append(True, (np.diff(place[order]) != 0) | (np.diff(hits[order, 0]) != 0))[: len(order)]
            hits = hits[order[fresh]]
            for at in range(0, len(hits), COMPARED):
                some = hits[at : at + COMPARED]
                begin = some[:, 4] + self.part_at[some[:, 2]] - SLACK
                where = np.clip(begin + np.arange(PART + 2 * SLACK + GRAIN)[:, None], 0, len(docs.chars) - 1)
                far = near_by(self.peq, some[:, 2], self.part_length[some[:, 2]], docs.chars[where] % CLASSES)
                out.update(map(tuple, some[far <= PART_EDITS * self.part_length[some[:, 2]]][:, [0, 1, 4]].tolist()))
        return out


def _places(piece: str, text: str) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def _hits(index: Index, texts: list[bytes]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """((text, item), (distance, first word)) of each text with each item that it contains."""
    docs = Plain(texts)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    seen: dict[tuple[int, int], int] = {}
    for d, k, at in sorted(index.candidates(docs)):
        text, allowed = index.texts[k], index.allowed[k]
        # nearer to the last one than GRAIN: the same region
        if at - seen.get((d, k), at - GRAIN) < GRAIN or best.get((d, k), (1,))[0] == 0:
            continue
        seen[d, k] = at
        # from the blank before the text's first word to the one after its last
        first, end = int(docs.starts[docs.firsts[d]]) - 1, int(docs.starts[docs.firsts[d] + docs.counts[d]])
        begin = max(first, at - allowed - GRAIN)
        got = distance_in(text, docs.text[begin : min(end, at + len(text) + allowed + GRAIN)])
        word = max(0, int(np.searchsorted(docs.starts, max(at + text.startswith(" "), first), "right")) - 1 - int(docs.firsts[d]))
        if got <= allowed and ((d, k) not in best or (got, word) < best[d, k]):
            best[d, k] = (got, word)
    return sorted(best.items())


def _matches(index: Index, key: str, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        found = _hits(index, texts)
        keys = part.column(key).take(pa.array([d for (d, _), _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array([index.ids[k] for (_, k), _ in found], kind), pa.array([at for _, (_, at) in found], pa.int64()), pa.array([d for _, (d, _) in found], pa.int32()), pa.array([1 - d / int(index.size[k]) for (_, k), (d, _) in found], pa.float64())],
            names=[key, "item_id", "first_word", "distance", "similarity"],
        )


def _clean(index: Index, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches, text):
        keep = np.ones(len(texts), bool)
        keep[[d for (d, _), _ in _hits(index, texts)]] = False
        yield part.filter(pa.array(keep))


def _blocks(benchmark: DataFrame, similarity: float, block: int) -> Iterator[Index]:
    items = []
    for r in benchmark.select("item_id", "text").toLocalIterator():
        items.append((r.item_id, r.text))
        if len(items) == block:
            yield Index(items, similarity)
            items = []
    if items:
        yield Index(items, similarity)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The documents that contain no item, with all their columns; one pass for each block of items."""
    for index in _blocks(benchmark, similarity, block):
        docs = docs.mapInArrow(lambda batches, index=index: _clean(index, text, batches), docs.schema)
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(key, item_id, first_word, distance, similarity): each document with each item that it contains."""
    scan = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    item = benchmark.schema["item_id"].dataType
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, item_id {item.simpleString()}, first_word bigint, distance int, similarity double"
    out = None
    for index in [*_blocks(benchmark, similarity, block)] or [Index([])]:
        part = scan.mapInArrow(lambda batches, index=index: _matches(index, key, to_arrow_type(item), batches), schema)
        out = part if out is None else out.unionByName(part)
    return out
