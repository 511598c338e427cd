"""Toxicity: Levenshtein automata over a lexicon trie, and context windows that separate quotation from abuse.

The lexicon is learned from labelled rows: words and word stems that many toxic documents have and clean ones don't,
chosen greedily so that each explains documents the stronger ones leave open. It is kept as a trie. A word is looked
up by running the Levenshtein automaton of the word over the trie: a state is the row of edit costs, a branch dies
when no cost is within the allowance (0 edits for stems and short words, 1 for words from FUZZY letters on), so misspelled terms are found
without listing them. Misspellings that clean training documents use as words are no hits. Every hit has a window of
WINDOW words around it: quotation marks around the hit and words of reporting weaken it, other hits and words of
address in the window strengthen it. A logistic model over the windows' sums gives the document's score.

The sample for fitting is bounded by SAMPLE_TOXIC and SAMPLE_CLEAN rows of at most SAMPLE_CHARS characters, the least
by hash of their id (of an id's several texts, the first in order); one task fits it, and only the model comes to the driver. Every document is scored, whole, in one pass over the table.

Edge cases: null and empty texts have no hit and get the model's score for none; labels that are null are not used,
of an id's several labels the highest counts; without toxic or clean labels, or labelled documents, the lexicon is empty and every
score is the prior; repeated rows are scored each. Extra columns are not carried.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.arrow import slices

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 6000, 20_000
WINDOW = 8
STEM, FUZZY = (4, 5, 6, 7, 8), 6
#: A term's rate among clean texts is at most this part of its rate among toxic ones.
IMPURE = 0.15
THRESHOLD = 0.7

EDGES = ".,;:!?\"'()[]{}<>«»“”„‚‘’…-–—*#&%$|/\\~`_+=@^"
QUOTES = frozenset("\"«»“”„‘’‹›")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "-": "", "_": "", ".": ""})
#: Fixed word lists, in English, German, French and Spanish: words of reporting, and words of address.
REPORTING = frozenset("said says called calls wrote writes quoted quote word term sagte sagt nannte schrieb wort zitat dit disait appelé écrit mot cité dijo dice llamó escribió palabra cita".split())
ADDRESS = frozenset("you your you're yourself u du dich dir dein ihr euch tu toi te vous ton tú te ti vos usted ustedes".split())


class Trie:
    """Terms by letter; a term is (text, stem, weight): a stem stands for every word that begins with it."""

    def __init__(self, terms: Iterable[tuple[str, bool, float]]) -> None:
        self.root: dict = {}
        for text, stem, _ in terms:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = (text, stem, 1 if len(text) >= FUZZY and not stem else 0)

    def search(self, word: str, most: int = 1) -> tuple[str, int] | None:
        """(term, edits) of the nearest term that the automaton of word accepts."""
        best: tuple[int, str] | None = None
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            if end := node.get(""):
                text, stem, allowed = end
                edits = min(row) if stem else row[-1]
                if edits <= min(allowed, most) and (best is None or (edits, text) < best):
                    best = (edits, text)
            for c, below in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for i, w in enumerate(word, 1):
                    new.append(min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (w != c)))
                if min(new) <= most:
                    stack.append((below, new))
        return best and (best[1], best[0])


@dataclass
class Model:
    """terms: (text, stem, weight); harmless: misspellings that clean documents use; weights: bias and one for each feature."""

    terms: tuple[tuple[str, bool, float], ...] = ()
    harmless: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)
    _found: dict[str, tuple[str, int] | None] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.trie = Trie(self.terms)
        fuzzy = [t for t, stem, _ in self.terms if len(t) >= FUZZY and not stem]
        self.weight = {t: w for t, _, w in self.terms}
        #: One edit leaves the first three or the last three letters of a word of six or more as they are.
        self.heads = {t[:3] for t, *_ in self.terms}
        self.tails = {t[-3:] for t in fuzzy}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": {}}

    def lookup(self, token: str) -> tuple[str, int] | None:
        """Of one token with its punctuation; remembered, in bounded memory."""
        if token in self._found:
            return self._found[token]
        if len(self._found) > 200_000:
            self._found.clear()
        word = token.strip(EDGES)
        got = self._match(word) if len(word) >= 3 else None
        if got is None and len(word) >= 3 and not word.isalpha():
            plain = word.translate(LEET)
            got = self._match(plain) if plain != word and len(plain) >= 4 else None
        self._found[token] = got
        return got

    def _match(self, word: str) -> tuple[str, int] | None:
        if word in self.harmless:
            return None
        if word[:3] in self.heads or word[-3:] in self.tails:
            return self.trie.search(word)
        return None

    def features(self, text: str) -> tuple[float, float, float, int, float]:
        """(log of the windows' sum, best window, log of the sum for each 100 words, hits, share of quoted hits)."""
        words = text.lower().split()
        look, known = self.lookup, self._found
        found = [known[w] if w in known else look(w) for w in words]
        hits = [i for i, x in enumerate(found) if x is not None]
        if not hits:
            return 0.0, 0.0, 0.0, 0, 0.0
        total, best, quoted = 0.0, 0.0, 0
        for n, i in enumerate(hits):
            lo, hi = max(0, i - WINDOW), i + WINDOW + 1
            near = [w.strip(EDGES) for w in words[lo:hi]]
            marks = QUOTES.intersection(words[i])
            before = sum(c in QUOTES for w in words[lo:i] for c in w)
            after = sum(c in QUOTES for w in words[i + 1 : hi] for c in w)
            quote = len(marks) > 0 and (words[i][0] in QUOTES or words[i][-1] in QUOTES) or before % 2 == 1 and after >= 1
            others = sum(1 for k in hits[max(0, n - WINDOW) : n + WINDOW + 1] if k != i and abs(k - i) <= WINDOW)
            term, edits = found[i]
            s = self.weight[term] * (1.0 if edits == 0 else 0.8)
            s *= 0.2 if quote else 1.0
            s *= 0.6 if not REPORTING.isdisjoint(near) else 1.0
            s *= 1 + 0.25 * min(others, 4) + (0.25 if not ADDRESS.isdisjoint(near) else 0.0)
            total, best, quoted = total + s, max(best, s), quoted + quote
        return math.log1p(total), best, math.log1p(100 * total / (len(words) + 50)), len(hits), quoted / len(hits)

    def score(self, f: tuple[float, float, float, int, float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], f, strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _candidates(text: str) -> set[tuple[str, bool]]:
    words = {w.strip(EDGES) for w in text.lower().split()}
    out = {(w, False) for w in words if 3 <= len(w) <= 24 and w.isalpha()}
    for n in STEM:
        out.update((w[:n], True) for w in words if len(w) > n and w[:n].isalpha())
    return out


def learn_terms(rows: list[tuple[str, int]], need: int = 3) -> list[tuple[str, bool, float]]:
    """Greedy cover: terms of toxic texts that clean ones hardly have, until each toxic text has ``need`` of them.
    A term comes with its weight: the log of how much more frequent it is in toxic texts, 1 at most."""
    texts = [t for t, y in rows if y]
    n_clean = len(rows) - len(texts)
    least = max(3, round(0.01 * len(texts)))
    rough = np.zeros(1 << 22, np.int32)  # counts by hash first: most candidates occur once and need no table of their own
    for t in texts:
        for c in _candidates(t):
            rough[hash(c) & 0x3FFFFF] += 1
    toxic = [{c for c in _candidates(t) if rough[hash(c) & 0x3FFFFF] >= least} for t in texts]
    seen: Counter = Counter(c for x in toxic for c in x)
    seen = Counter({c: k for c, k in seen.items() if k >= least})
    clean: Counter = Counter(c for t, y in rows if not y for c in _candidates(t) & seen.keys())
    per = len(toxic) / max(1, n_clean)
    pure = {c for c, k in seen.items() if clean[c] * per <= IMPURE * k}
    where: dict[tuple[str, bool], set[int]] = {c: set() for c in pure}
    for i, x in enumerate(toxic):
        for c in x & pure:
            where[c].add(i)
    left = [need] * len(toxic)
    out: list[tuple[str, bool, float]] = []
    while where:
        # a stem counts for less than the word itself, unless it stands for more of them
        gain = {c: sum(left[i] > 0 for i in at) * (1.0 if not c[1] else 0.9 - 0.01 * len(c[0])) - 4 * clean[c] * per for c, at in where.items()}
        c = max(gain, key=lambda k: (gain[k], k[0]))
        if gain[c] < least * 0.8:
            break
        rate = (len(where[c]) + 0.5) / (len(toxic) + 1)
        out.append((*c, min(1.0, math.log(rate / ((clean[c] + 0.5) / (n_clean + 1))) / 4)))
        for i in where.pop(c):
            left[i] -= 1
        for other in [k for k in where if k[0].startswith(c[0]) and c[1] or c[0].startswith(k[0]) and k[1]]:
            where.pop(other)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps with a ridge penalty."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_rows(rows: list[tuple[str, int]]) -> Model:
    """A model from labelled texts."""
    if len({y for _, y in rows}) < 2:
        return Model()
    terms = tuple(learn_terms(rows))
    rough = Model(terms)
    fuzzy: Counter = Counter()
    for t, y in rows:
        if not y:
            for w in {w.strip(EDGES) for w in t.lower().split()}:
                if len(w) >= 3 and rough._match(w):
                    fuzzy[w] += 1
    model = Model(terms, frozenset(fuzzy))
    x = np.array([model.features(t)[:3] for t, _ in rows])
    return Model(terms, frozenset(fuzzy), tuple(_logistic(x, np.array([y for _, y in rows])).tolist()))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 5) -> Model:
    """A model from the labelled documents; labels: (key, label), the rows that may be learned from."""
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter(F.length("t") <= SAMPLE_CHARS)
    known = known.join(rows.select("k").distinct(), "k", "left_semi")
    order = [F.xxhash64(F.lit(seed), "k"), F.col("k")]
    some = [known.filter(F.col("y") == y).orderBy(*order).limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    texts = rows.join(chosen, "k").groupBy("k", "y").agg(F.min("t").alias("t")).select("k", "t", "y")
    got = texts.repartition(1).mapInArrow(_fit, "model string").collect()  # one task for the bounded sample, none without rows
    if not got:
        return Model()
    terms, harmless, weights = json.loads(got[0].model)
    return Model(tuple(map(tuple, terms)), frozenset(harmless), tuple(weights))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("k", "t", "y")), strict=True))
    m = fit_rows([(t, y) for _, t, y in rows])
    yield pa.RecordBatch.from_pydict({"model": [json.dumps([m.terms, sorted(m.harmless), m.weights])]})


def _score(key: str, model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        f = [model.features(t.decode("utf-8", "replace")) for t in texts]
        yield pa.RecordBatch.from_arrays([part.column(key), pa.array([model.score(x) for x in f], pa.float64()), pa.array([x[3] for x in f], pa.int32()), pa.array([x[4] for x in f], pa.float64())], names=[key, "score", "hits", "quoted"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, hits, quoted) of every document."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(lambda b: _score(key, model, b), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, hits int, quoted double")


def _reject(model: Model, text: str, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches, text):
        keep = [model.score(model.features(t.decode("utf-8", "replace"))) < threshold for t in texts]
        yield part.filter(pa.array(keep, pa.bool_()))


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return docs.mapInArrow(lambda b: _reject(model, text, threshold, b), docs.schema)


def training_fold(key: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 3, isn't 1."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 != 1
