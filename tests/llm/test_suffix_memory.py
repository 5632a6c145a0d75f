"""A task holds a few slices at a time, however many its home has."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import suffix_dedup


@pytest.fixture
def corpus(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 600)
    docs = spark.createDataFrame([(k, f"{k} some words of a text " * 12) for k in range(80)], "doc_id long, text string").coalesce(1)
    with suffix_dedup._few_at_once(spark):
        made = suffix_dedup._Corpus(docs, 200)
        yield made
        made.drop()


def test_each_slice_is_a_row_group(corpus):
    files = [pq.ParquetFile(x.removeprefix("file:")) for x in corpus.texts.inputFiles()]
    assert len(files) == 1 and files[0].metadata.num_rows >= 20
    assert files[0].metadata.num_row_groups == files[0].metadata.num_rows


def test_arrow_batches_hold_few_slices(corpus):
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32())], ["n"])

    found = [r["n"] for r in corpus.with_answers().mapInArrow(rows, "n int").collect()]
    assert sum(found) >= 20 and max(found) <= 3


def test_settings_are_the_sessions_again(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.maxConcurrentOutputFileWriters")
    before = [spark.conf.get(x, None) for x in names]
    assert suffix_dedup.dedup(docs).count() == 1
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs, length=1)
    assert [spark.conf.get(x, None) for x in names] == before
