"""Many slices in one home and many buckets; texts stay where they are when answers are joined to them."""

import hashlib
import random

import pytest

from tessera.llm import suffix_dedup


def covered(raw, length):
    seen = {}
    for k, x in enumerate(raw):
        for i in range(len(x) - length + 1):
            seen.setdefault(x[i : i + length], []).append((k, i))
    gone = [bytearray(len(x)) for x in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    return gone


@pytest.fixture
def many(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 600)
    monkeypatch.setattr(suffix_dedup, "SORTED_TOGETHER", 4)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(80))
    texts = [" ".join(word() for _ in range(rng.randint(0, 150))) + (passage[rng.randint(0, 60) :] if k % 3 == 0 else "") for k in range(80)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_many_slices_of_one_home_match_brute_force(many):
    texts, docs = many
    corpus = suffix_dedup._Corpus(docs, 200)
    try:
        assert corpus.texts.select("home").distinct().count() == 1 and corpus.texts.count() >= 50 and corpus.buckets >= 500
    finally:
        corpus.drop()
    raw = [x.encode() for x in texts]
    found = {r["doc_id"]: r for r in suffix_dedup.dedup(docs).collect()}
    gone = covered(raw, 200)
    assert sum(map(sum, gone)) > 1000
    for k, (x, mask) in enumerate(zip(raw, gone, strict=True)):
        rest = bytes(b for b, m in zip(x, mask, strict=True) if not m)
        assert (found[k]["n_removed"], found[k]["kept_sha256"]) == (sum(mask), hashlib.sha256(rest).hexdigest())


def test_answers_are_rows_of_slices_and_texts_are_not_shuffled(many, capsys):
    _, docs = many
    corpus = suffix_dedup._Corpus(docs, 200)
    try:
        corpus.exchange(suffix_dedup.TUPLES)
        out = corpus.with_answers()
        assert out.count() == corpus.texts.count()
        assert all({a["step"] for a in r["answers"]} == {0} for r in out.where("octet_length(data) > 400").select("answers").collect())
        out.explain()
        plan = capsys.readouterr().out
    finally:
        corpus.drop()
    assert plan.count("Exchange") == 1 and "ShuffledHashJoin" in plan
