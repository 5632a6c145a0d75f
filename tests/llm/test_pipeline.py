"""The pipeline's stages against plain versions of what they decide."""

import pytest

pytest.importorskip("tessera.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import decontaminate, toxicity  # noqa: E402
from tessera.llm.common import materialise, read  # noqa: E402
from test_operators import near_components  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SMALL, "documents")
    columns = docs.columns
    kept, after = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialise(stage(spark, kept, SMALL))
        assert kept.columns == columns
        after[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    toxic = {r["doc_id"] for r in toxicity.score(docs, read(spark, SMALL, "labels")).where("predicted = 1").collect()}
    assert set(after["toxicity"]) == {r["doc_id"] for r in docs.collect()} - toxic
    assert set(after["line dedup"]) == set(after["toxicity"])
    own = near_components(after["line dedup"], 5)
    assert set(after["near-duplicates"]) == {k for k, (n, root) in own.items() if not n or root == k}
    left = spark.createDataFrame(list(after["decontamination"].items()), "doc_id long, text string")
    assert decontaminate.contamination(left, read(spark, SMALL, "benchmark")).where("contaminated").isEmpty()
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in packed.collect()} == set(after["decontamination"])


def test_hard_rows_and_an_empty_table_pass_all_stages(spark):
    """Nulls, empty and long texts, repeated rows and columns with names that stages use."""
    long_text = "\n".join(f"line {i} of a long text with words of its own" for i in range(20_000))
    rows = [(1, "a plain text of a few words"), (1, "a plain text of a few words"), (2, None), (None, "text without an id"), (None, None), (3, ""), (4, long_text), (5, " \n\t\n ")]
    docs = spark.createDataFrame([(*r, i, i, i, i, "en") for i, r in enumerate(rows)], "doc_id long, text string, _id int, _gone int, _toxic int, gone int, lang string")
    for kept in (docs, docs.limit(0)):
        some = not kept.isEmpty()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = materialise(stage(spark, kept, SMALL))
            assert kept.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
        if some:
            assert sum(r["doc_id"] is None for r in packed if r["piece"] == 0) == 2
            assert {r["doc_id"] for r in packed} == {None, 1, 2, 3, 4, 5}
        else:
            assert packed == []
