"""Every operator and stage on rows with nulls in any column, repeated rows, blank texts and extra columns whose names
an operator might use itself, and on empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from sparkweave.llm import decontaminate, html_text, jaccard, media, mixing, sharding, surrogates, toxicity, url_filter, wavelet

DATA = "/root/testdata/sf0.001"
#: Names that plans of the operators use for columns of their own.
CLASHING = (
    "key k sig sig__set check h x n m i at of row tie doc apart part slot shard grown_shard size place draw taken target budget source_size epochs upto words same rest root least first copies raw often "
    "gone_key gone_sig gone_check one_key one_sig set set_class component_id n_shingles toxic quality label score hits quoted attempt attempts found parts made mention kind norm n_entities lost "
    "item_id similarity host path rule listed verdict medium chunk digest blob payload feature start n_tokens ids unit html_text n_chars_ _range _order id value count"
).split()
TEXTS = [None, "", " \n\t ", "one", "two words here", "Mail a.b@c.example.com or 10.1.2.3", "Mail a.b@c.example.com or 10.1.2.3", " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(71)), "\x00 odd   é 漢字 🙂"]


def table(spark, columns, rows):
    """rows with the clashing columns, null in half of the rows; every row twice."""
    names = [c for c in CLASHING if c not in {x.split()[0] for x in columns.split(", ")}]
    kind = columns + ", " + ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame([(*r, *([None if i % 2 else "x"] * len(names))) for i, r in enumerate(rows) for _ in range(2)], kind)


@pytest.fixture(scope="module")
def docs(spark):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return table(spark, columns, [(i, t, lang, s, n) for t in TEXTS for i, lang, s, n in ((None, None, None, None), (len(t or ""), "en", "a", 1), (7, "en", None, None))])


@pytest.fixture(scope="module")
def pages(spark):
    page = "<html><body><article><p>One, two, three and a few words more.</p></article></body></html>"
    rows = [(i, u, h) for i in (None, 1, 2) for u in (None, "", "http://a.example.net/en/x?utm_source=1", "http://q.org/fr/") for h in (None, "", page, "<p", "\x00")]
    return table(spark, "page_id bigint, url string, html string", rows)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"you grobian number {i}" if i % 3 == 0 else f"a kind word number {i}") for i in range(300)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    return toxicity.fit(made, made.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS toxic").filter(toxicity.training_fold()))


def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(70))), (None, "two words here"), (3, None), (4, ""), (4, "")], "item_id bigint, text string")


def vocabulary():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


#: For each operator: one row for each row of the documents.
ROW_FOR_ROW = {
    "media": lambda d: media.media_columns(d),
    "sharding": lambda d: sharding.assign_shards(d, "doc_id", 5),
    "shuffled": lambda d: sharding.shuffle_documents(d, "doc_id", 5),
    "tokens": lambda d: wavelet.read_documents(wavelet.write_shards(d, vocabulary())),
    "surrogates": lambda d: surrogates.replace(d, "k"),
    "mixing": lambda d: mixing.mix_sizes(d),
    "jaccard": lambda d: jaccard.components(d),
}


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_row_for_row(docs, name):
    whole = ROW_FOR_ROW[name](docs)
    if name not in ("sharding", "shuffled"):
        got = Counter(r.doc_id for r in whole.select("doc_id").collect())
        assert got == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert whole.count() == docs.count()
    assert len({c.lower() for c in whole.columns}) == len(whole.columns)
    nothing = ROW_FOR_ROW[name](docs.limit(0))
    assert nothing.collect() == [] and nothing.columns == whole.columns


def test_scores(docs, model):
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(docs.limit(0), model).count() == 0
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() and toxicity.reject(docs.limit(0), model).count() == 0


def test_leaks(spark, docs):
    found = decontaminate.find_leaks(docs, benchmark(spark))
    assert {r.doc_id for r in found.select("doc_id").collect()} == {None, 7, len(TEXTS[4]), len(TEXTS[7]), len(TEXTS[8])}
    kept = decontaminate.drop_leaks(docs, benchmark(spark))
    assert kept.columns == docs.columns and kept.count() == docs.count() * 7 // 10
    assert decontaminate.find_leaks(docs.limit(0), benchmark(spark)).count() == 0
    assert decontaminate.drop_leaks(docs, benchmark(spark).limit(0)).count() == docs.count()
    assert decontaminate.find_leaks(docs, benchmark(spark).limit(0)).count() == 0


def test_mixed_rows(docs):
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns and mixing.mix(docs.limit(0)).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_one_of_each(docs):
    kept = jaccard.keep_one(docs)
    texts = Counter(r.text for r in kept.select("text").collect())
    assert kept.columns == docs.columns and texts[TEXTS[7]] + texts[TEXTS[8]] == 1 and texts["one"] == 1
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_pages(pages):
    text = html_text.extract(pages)
    assert Counter(r.page_id for r in text.select("page_id").collect()) == Counter({None: 40, 1: 40, 2: 40})
    assert {r.text for r in text.select("text").collect()} >= {"", "One, two, three and a few words more."} and html_text.extract(pages.limit(0)).count() == 0
    judged = url_filter.filter_urls(pages, url_filter.tracking_hosts(pages))
    assert judged.count() == pages.count() and {(r.host, r.verdict) for r in judged.collect()} == {("", "allow"), ("a.example.net", "allow"), ("q.org", "allow")}
    none = pages.limit(0)
    assert url_filter.filter_urls(none, url_filter.tracking_hosts(none)).count() == 0
    assert url_filter.filter_urls(pages, url_filter.tracking_hosts(none)).filter("listed").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, docs, stage):
    name, run = corpus_pipeline.STAGES[stage]
    for rows in (docs, docs.limit(0)):
        got = run(spark, rows, DATA)
        assert got.columns == docs.columns if stage < 4 else len(set(got.columns)) == len(got.columns) == len(docs.columns) + 2, name
        assert (got.count() > 0) == (rows.count() > 0), name
