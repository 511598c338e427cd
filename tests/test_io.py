from datetime import datetime

import pytest

from sparkweave.sources import io
from sparkweave.streaming import feedback


def test_metadata(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("file_id\timage_path\tsegmented_path\tspecies\tsource\n1\ta.jpg\tnan\tx\tlab\n2\tb.jpg\tb.png\ty\tfield\n2\tb.jpg\tb.png\ty\tfield\n")
    rows = io.read_metadata(spark, str(tmp_path / "m.tsv"))
    assert {(r.file_id, r.segmented_path) for r in rows.collect()} == {(1, None), (2, "b.png")}
    assert [r.file_id for r in io.new_rows(rows, rows.filter("file_id = 1")).collect()] == [2]
    assert [r.length for r in io.list_files(spark, str(tmp_path), "*.tsv").collect()] == [(tmp_path / "m.tsv").stat().st_size]


def test_written(spark, tmp_path):
    for i, n in enumerate((30, 20)):
        (tmp_path / f"{i}.bin").write_bytes(bytes(n))
    files = io.list_files(spark, str(tmp_path), "*.bin")
    assert tuple(io.written(files, 200).first()) == (2, 50, 25.0)
    assert tuple(io.written(files.limit(0), 0).first()) == (0, 0, 0.0)


def test_index(spark, tmp_path):
    index = spark.createDataFrame([(1, [1.0, 2.0])], "file_id bigint, v array<float>")
    io.save_index(index, str(tmp_path / "i"), "cosine")
    assert io.load_index(spark, str(tmp_path / "i"), "cosine").collect() == index.collect()
    with pytest.raises(ValueError, match="isn't one for l2"):
        io.load_index(spark, str(tmp_path / "i"), "l2")


def test_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h), k) for h, k in ((1, "clicked"), (1, "dismissed"), (2, "selected"))]
    spark.createDataFrame(rows, "created_at timestamp, feedback_type string").write.parquet(str(tmp_path / "in"))
    events = feedback.read_events(spark, str(tmp_path / "in"), "created_at timestamp, feedback_type string")
    run = feedback.hourly_rates(events).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r.hour.hour, r.events, r.ctr) for r in spark.table("rates").collect()) == [(1, 2, 0.5), (2, 1, 1.0)]
