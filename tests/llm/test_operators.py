"""The training-data operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import decontaminate, html_text, jaccard, media, mixing, sharding, surrogates, toxicity, url_filter, wavelet

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string"
WORDS = [f"w{i}" for i in range(300)]


def texts():
    rng = np.random.default_rng(1)
    out = [None, "", " \n", "one two three", "one two three", "a b c d e"]
    base = [" ".join(rng.choice(WORDS, 60)) for _ in range(12)]
    for b in base:
        words = b.split()
        near = list(words)
        near[rng.integers(60)] = "changed"
        out += [b, b.upper(), " ".join(near), " ".join(words[:40])]
    return [*out, " ".join(rng.choice(WORDS, 6000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or ""), "x") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[8]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(docs, empty):
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = jaccard.components(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), find(i)) for i, s in sets.items()}
    assert jaccard.components(empty).count() == 0


def test_jaccard_hot(spark):
    """A third of all sets in one group of near copies, another third exact copies, and one line in all texts."""
    rng = np.random.default_rng(11)
    line = " ".join(f"l{i}" for i in range(12))
    near = [f"g{i}" for i in range(80)]
    made = [" ".join([*near[:k], f"x{k}", *near[k + 1 :]]) + " " + line for k in rng.integers(80, size=700)]
    made += [" ".join(f"c{i}" for i in range(50)) + " " + line] * 700
    made += [" ".join(rng.choice(WORDS, 60)) + " " + line for _ in range(700)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id bigint, text string")
    assert jaccard.hot_shingles(spark.createDataFrame([(1, 10**6, [{"h": 5, "n": 10**5}])], "doc_id int, n bigint, often array<struct<h: bigint, n: bigint>>")) == {5: 10**5}
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    assert len(got) == 2100 and {got[i] for i in range(700)} == {0} and {got[i] for i in range(700, 1400)} == {700}
    assert all(got[i] == i for i in range(1400, 2100))


def test_sets_alike_in_half(spark):
    rows = spark.createDataFrame([(1, 7, 1, 3), (2, 7, 2, 3), (3, 7, 1, 3), (4, 8, 1, 3)], "doc_id int, sig bigint, check bigint, n bigint")
    got = {r.doc_id: (r.sig, r.raw) for r in jaccard.one_each(rows).collect()}
    assert got[1] == got[3] and len({got[1][0], got[2][0], 8}) == 3 and got[4] == (8, 8) and got[2][1] == 7


def test_jaccard_ids(spark):
    words = [f"n{i}" for i in range(60)]
    texts = [(3, " ".join(words)), (None, " ".join([*words, "a"])), (None, " ".join([*words, "b"])), (None, "quite alone"), (5, None), (5, "other text")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()), key=str)
    assert got == sorted([(3, 56, 3), (None, 57, 3), (None, 57, 3), (None, 1, None), (5, 0, 5), (5, 1, 5)], key=str)


def test_jaccard_beside_centres(spark):
    # every list that a and b are both in has a short text as its centre, which neither of them links with
    for seed in range(1000):
        rng = np.random.default_rng(seed)
        words = [f"x{rng.integers(1 << 40)}" for _ in range(104)]
        short = [" ".join(words[18 * i : 18 * i + 22]) for i in range(5)]
        a, b = " ".join(words), " ".join(words[:94] + [f"y{seed}z{i}" for i in range(10)])
        sets = [set(x.view(np.int64).tolist()) for x in jaccard.shingle_sets([t.encode() for t in [a, b, *short]])]
        least = sorted(sets[0] & sets[1])[:11]
        if max(sum(h in s for h in least) for s in sets[2:]) <= 4:
            break
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "x") for i, t in enumerate([a, b, *short])], SCHEMA)
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    assert got == {0: 0, 1: 0} | {i: i for i in range(2, 7)}


def test_leaks(spark, docs, empty):
    t = texts()
    words = t[6].split()
    items = [(1, " ".join(words[10:40])), (2, "never seen anywhere at all in any text here or there you see"), (3, None), (4, ""), (5, "one two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert {(6, 1), (7, 1), (9, 1), (3, 5), (4, 5)} <= got and not [g for g in got if g[1] in (2, 3, 4)]
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in got}
    assert decontaminate.find_leaks(empty, bench).count() == 0


def test_leak_recall():
    rng = np.random.default_rng(3)
    parts = "th er ing on re an he in ed tion st es at en nd ble ly ou ea ha".split()
    prose = lambda n: " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))
    items = [prose(int(rng.integers(15, 60))) for _ in range(30)]
    index = decontaminate.Index(list(enumerate(items)))

    def chars(t, rate):
        drawn = lambda: "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)]
        return "".join(c if rng.random() >= rate else ["", drawn(), drawn() + c][rng.integers(3)] for c in t)

    def typos(t, rate):
        return " ".join(w[:-1] + "x" if rng.random() < rate else w for w in t.split())

    edits = {"chars": lambda t: chars(t, 0.18), "typos": lambda t: typos(t, 0.6), "head": lambda t: t[int(0.18 * len(t)) :], "words": lambda t: " ".join("zork" if rng.random() < 0.15 else w for w in t.split())}
    for name, edit in edits.items():
        made = [f"{prose(30)} {edit(t)} {prose(30)}".encode() for t in items]
        near = {(d, k) for d, text in enumerate(made) for k, t in enumerate(items) if decontaminate.distance_in(t, text.decode()) <= int(0.2 * len(t) + 1e-9)}
        got = {pair for pair, _ in decontaminate._hits(index, made)}
        assert len(near) > 12 and len(near & got) >= 0.95 * len(near) and got <= near, name


@pytest.mark.parametrize("n_words", [1, 2, 3, 5, 7, 12, 30, 60, 200, 400])
def test_leak_recall_by_size(n_words):
    # random edits anywhere; what counts is what brute force accepts
    rng = np.random.default_rng(n_words)
    parts = "th er ing on re an he in ed tion st es at en nd ble ly ou ea ha".split()
    prose = lambda n: " ".join("".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(n))
    items = [prose(n_words) for _ in range(max(4, 200 // n_words))]
    index = decontaminate.Index(list(enumerate(items)))
    for share in (0.05, 0.1, 0.15, 0.2):
        made = []
        for t in items:
            c = list(t)
            for _ in range(int(share * len(t))):
                i = rng.integers(len(c))
                c[i] = ["", "q", "q" + c[i]][rng.integers(3)]
            made.append(f"{prose(20)} {''.join(c)} {prose(20)}")
        near = {(d, k) for d, text in enumerate(made) for k in range(len(items)) if decontaminate.distance_in(index.texts[k], f" {text} ") <= index.allowed[k]}
        got = {pair for pair, _ in decontaminate._hits(index, [m.encode() for m in made])}
        assert got <= near and len(got) >= 0.9 * len(near), (share, len(got), len(near))


def test_leak_walks():
    # runs of starts, words longer than a run's, characters beyond 16 bits: as one step after the other gives
    rng = np.random.default_rng(5)
    words = ["".join(chr(c) for c in rng.choice([97, 98, 99, 0xE9, 0x4E2D, 0x1F600], rng.integers(1, 9))) for _ in range(9000)]
    docs = decontaminate.Plain([" ".join([*words[:5000], "ab" * 30_000, *words[5000:]]).encode(), b"", b"one"])
    starts = docs.starts[:-1]
    walk = decontaminate.WALK.plan(1)[0]
    which, sig, middle, used = decontaminate.embed(docs.chars, starts, walk)
    assert which.tolist() == list(range(len(starts))) and len(starts) > 2 * decontaminate.RUN
    by_walk: dict[tuple, set[int]] = {}
    for i in rng.choice(len(starts), 500):
        at, seen = int(starts[i]), []
        for step in range(walk.sampled[-1] + 1):
            c = int(docs.chars[at])
            if step in walk.sampled:
                seen.append(c)
            at += step < walk.sampled[-1] and int(walk.value[c]) >> step & 1
        assert used[i] == at - starts[i] + 1
        by_walk.setdefault(tuple(seen), set()).add(int(sig[i]))
    assert all(len(s) == 1 for s in by_walk.values()) and len(set.union(*by_walk.values())) == len(by_walk)
    # walks that end half way lose no signature
    some = np.unique(rng.choice(len(starts), 300))
    kept, left, _, length = decontaminate.embed(docs.chars, starts, walk, decontaminate.Seen(middle[some]))
    assert set(some.tolist()) <= set(kept.tolist()) and len(kept) < len(starts)
    assert (left == sig[kept]).all() and (length == used[kept]).all()
    assert len(decontaminate.embed(docs.chars, starts[:0], walk)[0]) == 0


def test_leak_cost():
    # what is worked on at once doesn't grow with the slice, and walks in unlike texts end half way
    rng = np.random.default_rng(6)
    prose = lambda letters, n: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))
    index = decontaminate.Index([(i, prose("abcdefgh", 40)) for i in range(20)])
    docs = decontaminate.Plain([prose("ijklmnop", 100_000).encode()])
    tracemalloc.start()
    assert index.candidates(docs) == set()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * len(docs.starts)
    assert len(decontaminate.embed(docs.chars, docs.starts[:-1], index.walks[0], index.tables[0][-1])[0]) < len(docs.starts) / 10


def test_leak_ids(spark):
    docs = spark.createDataFrame([(None, "here is one two and more", "z"), ("b", None, "z"), ("b", "one tow", "z")], "doc_id string, text string, item_id string")
    bench = spark.createDataFrame([("x", "One, two"), (None, "one two"), ("y", "!")], "item_id string, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(None, "x", 0), (None, None, 0)}
    assert decontaminate.drop_leaks(docs, bench).collect() == docs.filter("doc_id IS NOT NULL").collect()
    long = spark.createDataFrame([("l", "word " * 200_000 + "one two", "z")], docs.schema)
    assert [r.first_word for r in decontaminate.find_leaks(long, bench).collect()] == [200_000] * 2


def test_edit_distance():
    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    rng = np.random.default_rng(2)
    for _ in range(200):
        p, t = ("".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(2))
        assert decontaminate.distance_in(p, t) == slow(p, t)


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, "doc_id", 7, rows_per_part=9).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    again = sharding.assign_shards(docs.repartition(3), "doc_id", 7, rows_per_part=9).collect()
    assert sorted((r.row.doc_id, r.shard, r.slot) for r in got) == sorted((r.row.doc_id, r.shard, r.slot) for r in again)
    assert sharding.shuffle_documents(docs, "doc_id", 7).count() == docs.count()
    assert sharding.assign_shards(empty, "doc_id", 7).count() == 0


def test_matrix():
    m = sharding.communication_matrix([5, 0, 20, 7], [11, 11, 10], 3)
    assert [sum(r) for r in m] == [5, 0, 20, 7] and [sum(c) for c in zip(*m, strict=True)] == [11, 11, 10]


def test_mixing(docs, empty):
    got = mixing.mix_sizes(docs).collect()
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        n, t, target = per.get(r.source, (0, 0, r.target))
        per[r.source] = (n + r.size, t + r.taken, target)
    total = sum(n for n, _, _ in per.values())
    assert abs(sum(t for *_, t in per.values()) - 1.5 * total) < 1e-6
    for n, taken, target in per.values():
        assert target <= 2 * n and abs(taken - target) <= 2
    words = sum(r.taken for r in got)
    assert mixing.mix(docs).agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == words
    assert mixing.mix(empty).count() == 0


def test_mixing_by_sql(spark, docs):
    """Whole results against the SQL, with null sources, equal rows and blank texts; ids may be null."""
    import duckdb

    from sparkweave.llm import queries

    rows = [tuple(r) for r in docs.collect()] + [(None, f"word {i}", "en", "a", 6, "x") for i in range(30)] + [(None, "same words here", "en", "c", 6, str(i)) for i in range(40)]
    odd = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", odd.toPandas().astype({"doc_id": "Int64"}))
    got = Counter((r.doc_id, r.size, r.source_size, r.target, r.taken, r.source) for r in mixing.mix_sizes(odd).collect())
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken, source FROM ({queries.OP8_SQL})").fetchall()
    assert got == Counter((None if i is None else int(i), *x) for i, *x in want)


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Net/x", "http://net/", "http://m.example.net/en/1", "http://xexample.net/en/1", "http://q.org/fr/?a", "http://q.org/de/?utm_source=1", "http://q.example.com/de/", "http://only.net"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.tracking_hosts(pages)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "/x", "net/", "block") and got[5][2:] == ("example.net/en/", "allow") and got[6][2] == "net/"
    assert got[7][2:] == ("org/fr/", "allow") and got[8][2:] == (None, "block") and got[10] == ("only.net", "", None, "allow")
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.build_cascade(universe)
    assert universe.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_media(docs, empty):
    got = media.media_columns(docs).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in got:
        p = media.payload_of(text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.media_columns(empty).count() == 0


def test_media_with_odd_ids(spark):
    """Null, repeated and text ids; copies, near copies that share chunks, chunks twice in a medium, and a long text."""
    rng = np.random.default_rng(6)
    base = " ".join(rng.choice(WORDS, 4000))
    twice = " ".join(rng.choice(WORDS, 3000)) + " "
    made = [("1", "solo text"), (None, "solo text"), ("2", "x"), (None, base), ("a", base), ("a", base), ("a", "other"), (None, base + " tail"), (None, "head " + base), ("b", twice * 3), (None, None), ("c", ""), (None, twice), ("d", "long " * 300_000)]
    made += [("copies", "one text of a third of all rows")] * 10
    docs = spark.createDataFrame(made, "doc_id string, text string")
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in media.media_columns(docs).collect())
    assert got == Counter((i, len((t or "").encode()), hashlib.sha256(media.payload_of((t or "").encode())).hexdigest()) for i, t in made)


def test_media_damage(spark):
    (row,) = (media._store_row(*g, set(), []) for g in media.chunks([media.encode(media.payload_of(b"some text"))]))
    assert media.read_back(spark.createDataFrame([tuple(row.values())], media.STORE)).count() == 1
    row["blob"] = media._squeeze(media._open(row["blob"])[:-1] + b"!")
    with pytest.raises(Exception, match="verify"):
        media.read_back(spark.createDataFrame([tuple(row.values())], media.STORE)).collect()


def test_wavelet(spark, docs, empty):
    ids = np.random.default_rng(4).integers(0, 50, 500)
    w = wavelet.WaveletMatrix(wavelet.build(ids, np.arange(2), np.array([200, 300])))
    assert w.ids().tolist() == ids.tolist() and [w.access(i) for i in range(500)] == ids.tolist()
    for t in (0, 7, 49, 1000):
        assert w.occurrences(t).tolist() == np.flatnonzero(ids == t).tolist() and w.rank(t, 250) == int((ids[:250] == t).sum())
    assert wavelet.WaveletMatrix(wavelet.build([], [], [])).ids().tolist() == []
    tokenizers = pytest.importorskip("public_tokenizers")
    path = str(tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in wavelet.read_documents(wavelet.write_shards(docs.dropDuplicates(["doc_id"]), path)).collect()}
    plain, start = wavelet.Encoder(path).tokenizer, 0
    for r in sorted(docs.dropDuplicates(["doc_id"]).collect(), key=lambda r: r.doc_id):
        want = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4")))
        start += len(want)
    assert wavelet.read_documents(wavelet.write_shards(empty, path)).count() == 0
    # equal and null ids, repeated rows, a text of many shards
    odd = spark.createDataFrame([(None, "a"), (None, "b c"), (3, "d"), (3, "d"), (1, None), (9, "long word " * 600_000)], "doc_id bigint, text string")
    found = wavelet.read_documents(wavelet.write_shards(odd, path)).collect()
    want = Counter((r.doc_id, zlib.crc32(np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))) for r in odd.collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [None, None, 1, 3, 3, 9]


PII = "Mail a.b7@Mail.example.com or A.B7@mail.example.com, +1 (858) 555-7280, 10.1.2.3, 4111111111111111, Mrs. Jane Doe, Mr. John Doe"


def test_wavelet_of_a_whole_shard():
    rng = np.random.default_rng(8)
    ids = np.where(rng.random(1 << 20) < 0.3, 7, rng.integers(3, 50_000, 1 << 20)).astype(np.uint32)
    ids[999::1000] = wavelet.END
    ids[-1] = wavelet.END
    ends = np.flatnonzero(ids == wavelet.END) + 1
    data = wavelet.build(ids, np.arange(len(ends)), np.diff(ends, prepend=0), wavelet.END)
    assert len(data) < 2.1 * len(ids)
    began = time.perf_counter()
    w = wavelet.WaveletMatrix(data)
    rare = int(ids[12_345])
    assert [w.access(i) for i in (0, 12_345, len(ids) - 1)] == [ids[0], rare, wavelet.END] and w._bits is None
    assert w.occurrences(rare).tolist() == np.flatnonzero(ids == rare).tolist() and w._bits is None or rare == 7
    assert w.select(7, 100_000) == np.flatnonzero(ids == 7)[100_000] and w.rank(7, 500_000) == int((ids[:500_000] == 7).sum())
    assert np.array_equal(w.occurrences(7), np.flatnonzero(ids == 7)) and time.perf_counter() - began < 1
    assert np.array_equal(w.documents()[1], np.diff(ends, prepend=0)) and np.array_equal(w.ids(), ids)


def test_memory_of_units(monkeypatch):
    """What an encoder remembers is small, also where units are long, and ids are the tokenizer's after it has forgotten."""
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    held = lambda: tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    coder, rng = wavelet.Encoder(path), np.random.default_rng(5)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 30, 20_000).tolist()) for _ in range(10)]
    coder.encode(texts[:1])
    tracemalloc.start()
    before = held()
    for t in texts[1:]:
        coder.encode([t])
    grown = held() - before
    assert grown < 100 * 20_000 * 9
    monkeypatch.setattr(wavelet.Encoder, "UNIT_BYTES", 1 << 22, raising=False)
    before = held()
    coder.encode([" ".join(f"{'xy' * 5_000}{i}" for i in range(700))])
    coder.encode(["a"])
    assert held() < before + (1 << 20)
    tracemalloc.stop()
    for t in (texts[0], "a x\ty z\nb  c", "xy" * 5_000 + " b\nc"):
        assert coder.encode([t, "", t])[0].tolist() == [*(own := [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2]), 2, *own]


def test_units_of_one_hash(monkeypatch):
    """Units that a hash doesn't tell apart are compared as texts."""
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    monkeypatch.setattr(wavelet, "_hashes", lambda units: np.arange(len(units), dtype=np.uint64) % np.uint64(3))
    coder = wavelet.Encoder(path)
    for t in ("the cat and the dog\nran", "a dog ran\nand the cat sat", "the cat and the dog\nran"):
        assert coder.encode([t])[0].tolist() == [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_surrogates(spark, empty):
    docs = spark.createDataFrame([(1, PII, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing 12 here", "x"), (5, PII, "x"), (5, PII, "x"), (None, PII, "x")], "doc_id bigint, text string, attempts string")
    got = {r.doc_id: r for r in surrogates.replace(docs, "k").collect()}
    for secret in ("a.b7@", "555-7280", "10.1.2.3", "4111111111111111", "Jane", "John"):
        assert secret not in got[1].text
    assert got[1].text == got[5].text == got[None].text and got[2].text is None and got[3].text == "" and got[4].text == "nothing 12 here" and got[1].n_entities == 7
    one, two = got[1].text.split()[1], got[1].text.split()[3]
    assert one.lower() == two.rstrip(",").lower() and "Mrs. " in got[1].text and "+1 (" in got[1].text
    assert surrogates.replace(docs, "another").filter("doc_id = 1").first().text != got[1].text
    assert surrogates.replace(docs, "k").count() == 7 and surrogates.replace(empty, "k").count() == 0


def test_long_text_with_entities(spark):
    docs = spark.createDataFrame([(1, "plain words " * 100_000 + "10.1.2.3 " + "and on " * 100_000)], "doc_id bigint, text string")
    (r,) = surrogates.replace(docs, "k").collect()
    assert r.n_entities == 1 and "10.1.2.3" not in r.text and r.text.startswith("plain words ") and r.text.endswith("and on ")


def test_check_digits(spark):
    docs = spark.createDataFrame([(1, "DE89 3704 0044 0532 0130 00"), (2, "GB82WEST12345698765432"), (3, "4111 1111 1111 1111")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in surrogates.replace(docs, "k").collect()}
    for i in (1, 2):
        bare = got[i].replace(" ", "")
        assert bare[:2] == ("DE", "GB")[i - 1] and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert got[1].count(" ") == 5 and got[1] != "DE89 3704 0044 0532 0130 00"
    digits = [int(c) for c in got[3] if c.isdigit()]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_patterns_find_what_all_alternatives_find(spark):
    """The patterns by characters against the plain alternatives, tried in order at each place."""
    plain = "|".join(f"(?:{p})" for p in surrogates.PATTERNS.values())
    bits = ["a@b.co", "x", "Mr", "Mrs. Ann", "Doe", "1.2.3.4", "(858) 555-7280", "+4", "123-45-6789", "AKIA" + "A" * 16, "ab" * 16, "sk-" + "z" * 20, "DE89370400440532013000", "4111111111111111", ".", "-", "ё", "Госпожа Анна"]
    rng = np.random.default_rng(9)
    made = ["".join(b + [" ", "", "\n"][rng.integers(3)] for b in rng.choice(bits, rng.integers(1, 7))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(made)), "i int, text string")
    text = F.col("text")
    assert docs.filter(surrogates.found_in(text) != F.regexp_extract_all(text, F.lit(plain), F.lit(0))).collect() == []
    assert docs.filter(F.size(surrogates.found_in(text)) > 0).count() > 1000


@pytest.mark.parametrize("max_redrawn", [surrogates.MAX_REDRAWN, 0])
def test_more_names_than_listed(spark, max_redrawn):
    letters = "abcdefghij"
    names = [f"Q{letters[i // 10 % 10]}{letters[i % 10]}{letters[i // 100]}" for i in range(1000)]
    docs = spark.createDataFrame([(i, f"Mr {n}, Mr. {n}") for i, n in enumerate(names)] + [(10_000 + i, f"Господин {n}") for i, n in enumerate("Аб Вг Де Жз".split())], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in surrogates.replace(docs, "k", max_redrawn=max_redrawn).collect()}
    assert len(set(got.values())) == 1004 and not set(names) & {w.strip(",") for t in got.values() for w in t.split()}
    assert all(len({w for w in t.replace(",", "").split() if w not in ("Mr", "Mr.")}) == 1 for i, t in got.items() if i < 10_000)


def test_toxicity(spark, empty):
    rng = np.random.default_rng(5)
    plain = lambda: list(rng.choice(WORDS, 40))
    rows = []
    for i in range(600):
        w = plain()
        if i % 3 == 0:
            w[5], w[20] = rng.choice(["grobian", "schuftig", "lumpenpack"], 2)
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "you grobjan and schufftig " + " ".join(plain()))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels.filter(toxicity.training_fold()))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows) and got[1002] >= 0.7 and got[1000] == got[1001] < 0.7
    assert toxicity.reject(docs, model).count() == 402
    # every score against a lookup by plain edit distance over all terms
    def plain(word):
        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b, 1):
                    new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
                row = new
            return row[-1]

        near = [(0 if stem else distance(t, word), t) for t, stem, _ in model.terms if (word.startswith(t) if stem else distance(t, word) <= (len(t) >= toxicity.FUZZY))]
        return min(near)[::-1] if near else None

    words = {w for _, t, _ in rows[:60] for w in t.split()} | {"grobjan", "schufftig", "lumpenpck", "gruban", "lumpenpackk"}
    assert all(model.trie.search(w) == plain(w) for w in words)
    odd = spark.createDataFrame([(None, "you grobian schuftig", 1, "x"), (7, "other", 0, "y"), (7, "other", 0, "y"), (8, "plain " * 200_000, 0, "z")], "doc_id bigint, text string, score int, k string")
    assert toxicity.score(odd, model).count() == 4 and toxicity.reject(odd, model).columns == odd.columns
    assert toxicity.score(empty, model).count() == 0


def test_html(spark):
    page = "<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One &amp; <b>two</b>,\n three.<p>Four<br>five</article><div class='comments'><p>Nice, very nice, so nice.</p></div><footer>end</footer>"
    assert html_text.main_text(page) == "Title One & two, three. Four five"
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>x</p", "x"), (5, "u", "<div>" * 3000 + "deep", "x"), (None, "u", page, "x"), (1, "u", page, "x")], "page_id bigint, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got[2] == got[3] == ("", 0) and got[5] == ("deep", 4) and got[None] == got[1]
    assert html_text.extract(pages).count() == 7 and html_text.extract(pages.limit(0)).count() == 0


def test_html_best_container():
    """The best container against a plain reading of the points, on pages of nested containers."""
    rng = np.random.default_rng(12)

    def made(depth):
        if depth == 0:
            words = ", ".join(rng.choice(WORDS, rng.integers(1, 40)))
            return f"<p>{words}</p>"
        return "<div>" + "".join(made(depth - 1) for _ in range(rng.integers(1, 4))) + "</div>"

    def points(node, d=1):
        total = 0.0
        for x in node.children:
            if isinstance(x, tuple):
                own = " ".join(x[0].split())
                total += (1 + own.count(",") + min(len(own) / 100, 3)) / (1 if d == 2 else 2 if d == 3 else 3 * (d - 1)) if 1 < d <= html_text.REACH + 1 and own else 0
            else:
                total += points(x, d + 1)
        return total

    for _ in range(50):
        root, nodes = html_text.parse(made(int(rng.integers(1, 5))))
        html_text.score(nodes)
        assert all(abs(x.points - points(x)) < 1e-9 for x in nodes if x.tag == "div")


@pytest.mark.parametrize("page", ["<a '", "<div>a", "<p><td>a</p>", "</x><b>", "<!--", "<a", "<a \"'>", "<script", "&lt;a, "])
def test_html_time(page):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        html_text.main_text(page * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 0.5 + 12 * took[0]
