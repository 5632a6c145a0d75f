"""Token counts, the Merkle manifest and hard negatives against the libraries and plain versions, and on hard inputs."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("tessera.llm")

import sentencepiece  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import hard_negatives, line_dedup, merkle, token_counts, toxicity  # noqa: E402
from tessera.llm.common import read  # noqa: E402

SMALL = "/root/testdata/sf0.001"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, source string, lang string, n_chars int"


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: list(map(len, model.encode(texts)))
    coder = Tokenizer.from_file(path)
    return lambda texts: [len(e.ids) for e in coder.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", (BYTE, PIECE))
@pytest.mark.parametrize("window", (1 << 20, 200, 70))
def test_counts_of_random_strings(path, window):
    rng = random.Random(window)
    parts = ["a", "B", " ", "  ", "\n", "\t", "<|endoftext|>", "<|", "|>", "▁", "é", "日本", "　", "\xa0", "'s", "1", ".", "<s>", "</s>", "\r\n", "endoftext", "\U0001f600", "zz top"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(5000)]
    sizes, tokens = token_counts.Counter(path, memory=1 << 16).count(pa.array(texts), window)
    assert tokens.tolist() == library(path)(texts)
    assert sizes.tolist() == [len(t.encode()) for t in texts]


@pytest.mark.parametrize("path", (BYTE, PIECE))
def test_counts_of_all_documents(spark, path):
    docs = read(spark, SMALL, "documents")
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, path, window=1000).collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert found == {i: (len(t.encode()), n, n > 512) for (i, t), n in zip(rows, library(path)([t for _, t in rows]), strict=True)}


def test_counts_of_hard_rows(spark):
    long_text = "word " * 300_000 + "x" * 200_000
    rows = [(1, None), (1, ""), (2, "a b"), (2, "a b"), (None, "c"), (3, long_text)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_tokens int, batch int")
    found = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, BYTE).collect())
    assert found == sorted([(1, 0, 0, False), (1, 0, 0, False), (2, 3, 2, False), (2, 3, 2, False), (0, 1, 1, False), (3, len(long_text), library(BYTE)([long_text])[0], True)])
    assert token_counts.count_tokens(docs.limit(0), BYTE).collect() == []


def plain_tree(nodes):
    """The root, and for each node its siblings level by level with its place among them."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 8, len(nodes))) for a in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for i in owners[k]:
                    paths[i].append((k - run[0], [nodes[j] for j in run if j != k]))
        owners = [[i for k in run for i in owners[k]] for run in runs]
        nodes = [hashlib.sha256("".join(nodes[k] for k in run).encode()).hexdigest() for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    def leaf(doc_id, text, source, lang, n_chars):
        parts = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
        return hashlib.sha256("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in parts).encode()).hexdigest()

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r[3] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    own, roots = {}, []
    for lang in langs:
        leaves = sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[3] == lang), key=lambda x: x[:3])
        own[lang] = (leaves, *plain_tree([x[2] for x in leaves]))
        roots.append(own[lang][1])
    root, tops = plain_tree(roots)
    out = []
    for lang, top in zip(langs, tops, strict=True):
        leaves, subroot, paths = own[lang]
        for (_, _, digest, r), path in zip(leaves, paths, strict=True):
            whole = path + top
            proof = hashlib.sha256("".join(x for _, others in whole for x in others).encode()).hexdigest()
            folded = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                folded = leaf(r[0], r[1].translate(lower), *r[2:])
            for k, others in whole:
                folded = hashlib.sha256("".join([*others[:k], folded, *others[k:]]).encode()).hexdigest()
            out.append((r[0], digest, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def manifest_of(docs, height=merkle.HEIGHT):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(docs, F.when(chosen, F.translate("text", merkle.UPPER, merkle.UPPER.lower())), height).collect()
    return sorted(map(tuple, found), key=str)


@pytest.mark.parametrize("height", (1, 2, 4))
def test_manifest_equals_a_plain_tree(spark, height):
    """Blocks of 8 and 64 leaves need several traversals; languages with 1, 8, 9 and 700 rows end at different levels."""
    sizes = {"en": 700, "de": 9, None: 8, "": 1, "zz": 65, "é": 2}
    rows = [(i, f"Text {i} of {lang}", "web", lang, i) for lang, n in sizes.items() for i in range(n)]
    rows = [(7 * i % 1009 + 3 * k, *r[1:]) for k, (i, r) in enumerate(enumerate(rows))]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert manifest_of(docs, height) == plain_manifest(rows)


def test_manifest_of_more_than_eight_languages(spark):
    rows = [(i, f"T{i}", None, f"l{i % 70:02d}", None) for i in range(200)]
    assert manifest_of(spark.createDataFrame(rows, DOCS), 1) == plain_manifest(rows)


def test_manifest_of_hard_rows(spark):
    rows = [(1, "Same", "a", "en", 4)] * 300 + [(1, "Other", "a", "en", 4), (None, None, None, None, None), (None, "X", "", "en", 0), (5, "", "-", "en", None), (6, "ABC ß " * 100_000, "s", "fr", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as tree", "2 as rank", "'x' as root")
    assert manifest_of(docs) == plain_manifest(rows)
    assert merkle.manifest(docs.limit(0)).collect() == []


def plain_mining(rows, every=100, positives=5, negatives=10, low=30, high=90):
    usable = [(i, label, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in usable), default=0)
    v = np.array([np.pad(x, (0, width - len(x))) for *_, x in usable]).reshape(len(usable), width)
    out = []
    for a, (i, label, _) in enumerate(usable):
        if i % every:
            continue
        score = v @ v[a]
        order = sorted((b for b in range(len(usable)) if b != a), key=lambda b: (-score[b], usable[b][0]))
        for p in [b for b in order if usable[b][1] == label][:positives]:
            fits = [b for b in order if usable[b][1] != label and low * score[p] <= 100 * score[b] <= high * score[p]]
            out += [(i, usable[p][0], k, usable[b][0], int(score[p]), int(score[b])) for k, b in enumerate(fits[:negatives], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("together", ((10_000, 1_000_000), (3, 60)))
def test_mining_equals_brute_force(spark, together):
    """Clustered vectors with copies (ties) and one label that holds a third of the rows; one cell or many."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(size=24) * 0.8).astype(np.float32).tolist(), int(rng.choice([1, 1, 1, 2, 3, 4, 5]))) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 2) for i in range(40)]
    df = spark.createDataFrame(rows, VECTORS)
    found = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, 3, 4, 20, 80, *together)
    want = plain_mining(rows, 50, 3, 4, 20, 80)
    assert len(want) > 100 and sorted(map(tuple, found.collect())) == want


def test_pairs_are_discarded_early():
    """Where leading components hold most of the products, few pairs reach the last stage; none that counts is lost."""
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(size=(800, 32)) * 0.8 ** np.arange(32)).astype(np.int64)
    turn = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    anchors = hard_negatives.Anchors(turn, hard_negatives._stages(32))
    anchors.parts.append((np.arange(20), np.zeros(20, np.int64), v[:20]))
    anchors.close()
    exact = v @ v[:20].T
    low = np.sort(exact, axis=0)[-6]
    at, to, score = hard_negatives.surviving(anchors, v, np.ones(exact.shape, bool), low.astype(float), np.full(20, np.inf))
    assert sorted(zip(at, to, strict=True)) == sorted(zip(*np.nonzero(exact >= low), strict=True)) and (score == exact[at, to]).all()
    part = (v @ turn)[:, :8] @ (v[:20] @ turn)[:, :8].T
    assert np.abs(exact - part).mean() < 0.3 * np.abs(exact).mean()


def test_mining_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.25], 2), (3, [0.5], 2), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, None, 1), (7, [1.0, None], 2), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [], 2), (100, [0.0, 0.0], 3), (0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS + ", row int, v int")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())) == plain_mining(rows)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("vec_id") == 77).collect() == []


def test_one_long_text_does_not_end_training(spark):
    """Wherever its id's hash stands: it is left out of the sample, the others stay. Repeated rows count once."""
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"), read(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "toxic")
    before = toxicity.train(docs, labels, sample_mb=1)
    assert before is not None
    for doc_id in (3_000_001, 3_000_002, 3_000_004):  # not held out
        long_docs = docs.union(spark.createDataFrame([(doc_id, "a long and harmless text " * 60_000)], "doc_id long, text string"))
        after = toxicity.train(long_docs, labels.union(spark.createDataFrame([(doc_id, 0)], "doc_id long, toxic int")), sample_mb=1)
        assert after.slot == before.slot and np.allclose(after.weight, before.weight)
    assert toxicity.train(docs.union(docs), labels, sample_mb=1).slot == before.slot


def test_line_dedup_of_very_many_lines(spark):
    """Steps that grow with the lines of a text; every third line repeats an earlier one, in pairs with its neighbour."""
    lines = [f"line {i % 3 and i or i % 30_000} of a long text" for i in range(120_000)]
    docs = spark.createDataFrame([(2, "\n".join(lines)), (1, "\n".join(lines[:5000]))], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    seen, gone = set(), set()
    for i in range(len(lines) - 1):
        pair = (lines[i], lines[i + 1])
        if pair in seen or i + 1 < 5000:
            gone |= {i, i + 1}
        seen.add(pair)
    assert found == {1: "\n".join(lines[:5000]), 2: "\n".join(x for i, x in enumerate(lines) if i not in gone)}
    assert line_dedup.report(docs).count() == 2
    assert time.time() - began < 60
