"""The pipeline on the smallest tables: what each stage keeps, against the operators' own plain readings."""

import corpus_pipeline
from sparkweave.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_null_and_clashing_ids(spark):
    near = [f"n{i}" for i in range(60)]
    texts = [(None, "one"), (None, "two words"), (None, ""), (None, ""), (7, "quite another text"), (7, "and again one"), (7, "and again one"), (8, ""), (8, ""),
             (3, " ".join(near)), (9, " ".join([*near, "more"])), (9, "not a copy of any"), (None, " ".join([*near, "last"])), (None, "two words")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.STAGES[1][1](spark, docs, DATA).collect()), key=str)
    want = [*texts[:6], (8, ""), (3, " ".join(near)), (9, "not a copy of any")]
    assert got == sorted(want, key=str)


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, DATA).cache()
        assert kept.columns == columns, name
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in kept.collect()}
        assert after.items() <= before.items()
        if name == "benchmark_decontamination":
            items = [r.text for r in table(spark, DATA, "benchmark").collect()]
            exact = {i for i, t in before.items() if any(x in t for x in items)}
            assert not exact & after.keys()
        docs = kept
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, DATA).cache()
    placed = corpus_pipeline.STAGES[4][1](spark, mixed, DATA).collect()
    assert mixed.columns == columns and len(placed) == mixed.count()
    assert len({(r.shard, r.slot) for r in placed}) == len(placed)
