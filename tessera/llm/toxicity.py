"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Documents are labelled, tokens are not, so token labels are latent. They start from features (the whole word, or its first
letters) that occur in toxic training documents and practically never in others; then the chain is fitted with all features
that lean to toxic documents, and the marginals it gives the tokens of toxic documents are their labels for the next fit
(``rounds`` times). Tokens of other documents stay clean. Scoring takes whole texts: tokens without features share one
emission, so the runs between the others are powers of one 2 x 2 matrix, and forward-backward gives each token's marginal.
The expected number of toxic tokens, calibrated on the training documents, is the score; tokens with a marginal of one half
or more are the offending spans.

Bounds of the fit, all parameters of ``train``: at most ``sample`` labelled rows of each class, those with the smallest hash
of their id, whose texts together have at most ``sample_mb`` MB, each at most a hundredth of that; at most ``most`` features; at most ``places`` stretches a
text, drawn at random from its tokens with features, and ``stretches`` in all. Everything else covers all rows.

Null and empty texts have no tokens and get the score of no toxic token; very long texts are scored whole. Null labels are
no labels; a ``doc_id`` with several labels is used for each; ties of the hash go by id; without training rows of both
classes every score is 0. Repeated rows each get a row; extra columns are ignored by ``score`` and kept by ``clean``; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, own, read, slices, without

FOLDS = 5
#: Per byte: lower case, and a blank for ASCII that is not a letter.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"\S+")
STRETCH = 24


def features(word: bytes) -> list[bytes]:
    """The whole word (closed by a blank) and its first three to six bytes."""
    return [word + b" ", *(word[:k] for k in range(3, min(6, len(word)) + 1))]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Chain:
    """Two states, clean and toxic; the clean state scores 0 for every token."""

    def __init__(self, names: list[bytes]):
        self.slot = {f: i for i, f in enumerate(names)}
        self.weight, self.bias, self.step = np.zeros(len(names)), -2.0, np.zeros((2, 2))
        self.intercept, self.slope = -3.0, 2.0
        self._finish()

    def _finish(self) -> None:
        self.heads = {f[:3] for f in self.slot}
        m = np.exp(self.step + np.array([0.0, self.bias]))
        values, left = np.linalg.eig(m)
        top = int(np.argmax(values.real))
        self.ratio = float(values.real[1 - top] / values.real[top])
        inverse = np.linalg.inv(left)
        self.parts = [np.outer(left[:, k], inverse[k]).real for k in (top, 1 - top)]

    def gap(self, n: int) -> np.ndarray:
        """Up to a factor: the product over ``n`` tokens without features."""
        return self.parts[0] + self.ratio**n * self.parts[1]

    def fit(self, sequences: list[tuple[list[list[int]], np.ndarray]], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> None:
        """Gradient ascent (Adam) on the expected likelihood of equally long stretches: lists of feature slots, and each
        token's probability of being toxic."""
        n = len(sequences)
        y = np.array([labels for _, labels in sequences], float)
        token = np.array([i * STRETCH + t for i, (feats, _) in enumerate(sequences) for t, f in enumerate(feats) for _ in f], np.int64)
        slot = np.array([s for feats, _ in sequences for f in feats for s in f], np.int64)
        theta, first, second = np.concatenate([self.weight, [self.bias], self.step.ravel()]), 0.0, 0.0
        k = len(self.weight)
        both = (1 - y, y)
        true = np.array([[(both[i][:, :-1] * both[j][:, 1:]).sum() for j in (0, 1)] for i in (0, 1)])
        for it in range(1, rounds + 1):
            w, b, step = theta[:k], theta[k], theta[k + 1 :].reshape(2, 2)
            emit = np.ones((n, STRETCH, 2))
            emit[..., 1] = np.exp(np.clip(b + np.bincount(token, w[slot], n * STRETCH).reshape(n, STRETCH), -30, 30))
            move = np.exp(step)
            alpha, beta = np.empty_like(emit), np.ones_like(emit)
            alpha[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
            for t in range(1, STRETCH):
                a = (alpha[:, t - 1] @ move) * emit[:, t]
                alpha[:, t] = a / a.sum(1, keepdims=True)
            for t in range(STRETCH - 2, -1, -1):
                c = (beta[:, t + 1] * emit[:, t + 1]) @ move.T
                beta[:, t] = c / c.sum(1, keepdims=True)
            p = alpha * beta
            p = (p / p.sum(2, keepdims=True))[..., 1]
            pair = alpha[:, :-1, :, None] * move * (emit * beta)[:, 1:, None, :]
            pair = (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))
            miss = (y - p).ravel()
            gradient = np.concatenate([np.bincount(slot, miss[token], k), [miss.sum()], (true - pair).ravel()]) / n - ridge * theta
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            theta = theta + rate * (first / (1 - 0.9**it)) / (np.sqrt(second / (1 - 0.999**it)) + 1e-8)
        self.weight, self.bias, self.step = theta[:k], float(theta[k]), theta[k + 1 :].reshape(2, 2)
        self._finish()

    def marginals(self, words: list[bytes]) -> tuple[list[int], np.ndarray]:
        """Places of the words that have features, and their probabilities of the toxic state."""
        heads, slot = self.heads, self.slot
        at, found = [], []
        for i in [i for i, w in enumerate(words) if w[:3] in heads or (len(w) < 3 and w + b" " in slot)]:
            if own_features := [slot[f] for f in features(words[i]) if f in slot]:
                at.append(i)
                found.append(own_features)
        return at, self._chain(at, found, len(words))

    def posterior(self, part: list[list[int]]) -> np.ndarray:
        """The same for tokens given by their features' slots, 0 where there are none."""
        at, out = [i for i, f in enumerate(part) if f], np.zeros(len(part))
        out[at] = self._chain(at, [part[i] for i in at], len(part))
        return out

    def _chain(self, at: list[int], found: list[list[int]], length: int) -> np.ndarray:
        """Forward-backward over the tokens with features, the others between them taken at once."""
        if not at:
            return np.zeros(0)
        emits = [np.array([1.0, np.exp(np.clip(self.bias + self.weight[f].sum(), -30, 30))]) for f in found]
        move, state, forward = np.exp(self.step), None, []
        for k, (i, emit) in enumerate(zip(at, emits, strict=True)):
            if k == 0:
                state = np.array([1.0, np.exp(self.bias)]) @ self.gap(i - 1) @ move if i else np.ones(2)
            else:
                state = state @ self.gap(i - at[k - 1] - 1) @ move if i - at[k - 1] > 1 else state @ move
            state = np.maximum(state * emit, 1e-300)
            state = state / state.sum()
            forward.append(state)
        back, out = self.gap(length - 1 - at[-1]).sum(1), np.zeros(len(at))
        for k in range(len(at) - 1, -1, -1):
            both = np.maximum(forward[k] * back, 1e-300)
            out[k] = both[1] / both.sum()
            if k:
                n = at[k] - at[k - 1] - 1
                back = move @ (emits[k] * back) if not n else self.gap(n) @ (move @ (emits[k] * back))
                back = back / back.sum()
        return out

    def score(self, marginals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(marginals.sum())))))

    def calibrate(self, sums: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of the labels on log(1 + expected toxic tokens), a small ridge on the slope."""
        x, theta = np.stack([np.ones(len(sums)), np.log1p(sums)], 1), np.array([0.0, 1.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            gradient = x.T @ (weight * (y - p)) - np.array([0, 1e-2]) * theta
            theta = theta + np.clip(np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag([1e-6, 1e-2]), gradient), -2, 2)
        self.intercept, self.slope = map(float, theta)


def _surprise(toxic: int, other: int, n: np.ndarray) -> float:
    """Minus the log of a bound on the chance that so many of a feature's documents are toxic ones."""
    share, base = toxic / (toxic + other), n[1] / n.sum()
    return (toxic + other) * (share * log(share / base) + (log((1 - share) / (1 - base)) * (1 - share) if other else 0.0))


def _chosen(docs: DataFrame, labels: DataFrame, sample: int, sample_mb: int) -> list:
    """The training rows (toxic, text): at most ``sample`` of each class and ``sample_mb`` MB of text together."""
    usable = own(labels, "doc_id", "toxic").where("toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = chosen[0].union(chosen[1]).select(F.col("doc_id").alias("_id"), "toxic")  # at most 2 x sample ids
    rows = own(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = rows.withColumn("text", text).withColumn("size", F.octet_length("text"))
    # a text of more than its share of the bytes could keep all others out; of rows with one id and label one is enough
    rows = rows.where(F.col("size") <= max(1, (sample_mb << 20) // 100)).groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = materialise(rows.select("toxic", F.xxhash64("doc_id", "toxic").alias("h"), "text", F.octet_length("text").alias("size")))
    total, last = 0, None
    for h, size in sorted((r["h"], r["size"]) for r in rows.select("h", "size").collect()):  # at most 4 x sample rows
        total += size
        if total > sample_mb << 20:
            break
        last = h
    return [] if last is None else rows.where(F.col("h") <= last).select("toxic", "text").collect()


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, sample_mb: int = 64, least: int = 3, most: int = 20_000, places: int = 20, stretches: int = 6000, rounds: int = 2, lean: float = 6) -> Chain | None:
    """Fit on labelled rows outside the held-out fold. ``least``: toxic documents that a feature needs; ``lean``: how
    many times as often it has to occur in toxic documents as in others; the other bounds are in the module's text."""
    usable = own(labels, "doc_id", "toxic").where("toxic is not null").where(~held_out(F.col("doc_id")))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    if len(totals) < 2:
        return None
    rows = _chosen(docs, labels, sample, sample_mb)
    y = np.array([r["toxic"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return learn([bytes(r["text"]).translate(_FOLD).split() for r in rows], y, totals, least, most, places, stretches, rounds, lean)


def learn(texts: list[list[bytes]], y: np.ndarray, totals: dict[int, int], least: int, most: int, places: int, stretches: int, rounds: int, lean: float) -> Chain | None:
    """The chain for tokenized texts and their labels; ``totals``: labelled rows of each class, to calibrate the score."""
    seen = (Counter(), Counter())
    for words, label in zip(texts, y.tolist(), strict=True):
        seen[label].update({f for w in set(words) for f in features(w)})
    n = np.bincount(y, minlength=2)
    ratio = {f: (c / n[1]) / ((seen[0][f] + 0.5) / n[0]) for f, c in seen[1].items() if c >= least}
    weight = {f: _surprise(seen[1][f], seen[0][f], n) for f, r in ratio.items() if r >= min(lean, 5)}
    evident = {f for f, w in weight.items() if w > log(20 * len(ratio))}  # not by chance among so many features
    # practically never in other documents: the first labels
    pure = {f for f in evident if ratio[f] >= 5 and seen[0][f] * n[1] <= 0.05 * seen[1][f] * n[0]}
    names = sorted((f for f in evident if ratio[f] >= lean), key=lambda f: (-weight[f], f))[:most]
    if not pure or not names:
        return None
    model = Chain(names)
    marks = {model.slot[f] for f in pure if f in model.slot}
    rng, cut = np.random.default_rng(0), []
    for words, label in zip(texts, y.tolist(), strict=True):
        found = [[model.slot[f] for f in features(w) if f in model.slot] if w[:3] in model.heads else [] for w in words]
        first = [i for i, f in enumerate(found) if not marks.isdisjoint(f)]
        other = [i for i, f in enumerate(found) if f]
        chosen = rng.permutation(first)[:places].tolist() + rng.permutation(other)[: places // 4].tolist() + (rng.integers(0, len(words), 2).tolist() if words else [])
        for i in dict.fromkeys(map(int, chosen)):
            a = max(0, min(i - int(rng.integers(0, STRETCH)), len(words) - STRETCH))
            part = found[a : a + STRETCH]
            cut.append((part + [[]] * (STRETCH - len(part)), label))  # a short text is filled up with tokens without features
    if len(cut) > stretches:
        cut = [cut[i] for i in rng.choice(len(cut), stretches, replace=False)]
    hidden = [np.array([float(label == 1 and not marks.isdisjoint(f)) for f in part]) for part, label in cut]
    for turn in range(rounds):
        model.fit([(part, z) for (part, _), z in zip(cut, hidden, strict=True)])
        if turn < rounds - 1:
            hidden = [model.posterior(part) if label == 1 else z for (part, label), z in zip(cut, hidden, strict=True)]
    sums = np.array([model.marginals(words)[1].sum() for words in texts])
    model.calibrate(sums, y, np.where(y == 1, totals[1] / n[1], totals[0] / n[0]) / sum(totals.values()) * len(y))
    return model


SCORED = "score double, n_toxic long, spans array<struct<start: int, stop: int, marginal: double>>"


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic, spans) for every row; spans are places of characters in the text."""
    docs = own(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def tag(batches):
        model = shared.value
        for batch in slices(batches, 1):
            scores, counts, spans = [], [], []
            for text in batch.column(1).cast("binary").to_pylist():
                text = text or b""
                folded = text.translate(_FOLD)
                at, p = model.marginals(folded.split()) if model else ([], np.zeros(0))
                scores.append(model.score(p) if model else 0.0)
                toxic = [(i, float(q)) for i, q in zip(at, p.tolist(), strict=True) if q >= 0.5]
                counts.append(len(toxic))
                own_spans = []
                if toxic:
                    places, done, chars = [m.span() for m in _WORD.finditer(folded)], 0, 0
                    for i, q in toxic:
                        a, b = places[i]
                        chars += len(text[done:a].decode())
                        own_spans.append({"start": chars, "stop": chars + len(text[a:b].decode()), "marginal": q})
                        done = a
                spans.append(own_spans)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, kind)], ["doc_id", "score", "n_toxic", "spans"])

    out = docs.mapInArrow(tag, f"doc_id long, {SCORED}")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return without(docs, score(docs, labels, **options).where("predicted = 1").select("doc_id").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
