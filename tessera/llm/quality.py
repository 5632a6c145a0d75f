"""Quality rules with risk-controlled cutoffs.

Texts are reduced to a few counts in one pass; nothing but those counts is shuffled. Rows with the label of good quality are
the holdout, of which one half (by hash of ``doc_id``) proposes cutoffs and the other certifies them, for each stratum
(``lang`` here) on its own.

Proposal: a step of the list ``steps(risk)`` is a share and a margin. Every rule gets the strictest cutoff that rejects at
most the share of the first half, times the margin. The list follows from ``risk`` and the number of rules alone: cutoffs
above all that half has, their margins falling from 2 to 1 by fourth roots, then each rule's equal part of ``risk``, from an
eighth of it doubling to the whole. Certification: the rows of the second half that any rule rejects at step j are counted,
and the step holds while the exact binomial (Clopper-Pearson) upper bound on that joint rejection rate is at most ``risk``.
Steps are tested in their fixed order up to the first failure, which needs no correction; the error probability ``delta``
is divided by the number of strata (Bonferroni). With probability 1 - ``delta`` all strata together therefore reject by
rules at most the share ``risk`` of their good documents that pass the base rules; what those reject is fixed, not learnt,
and outside the certificate. A stratum without a certified step rejects nothing by rules.

Cutoffs stay a table with a row for each stratum; only the number of strata comes to the driver. Up to ``BROADCAST_STRATA``
of them are broadcast, more are joined.

Null and empty texts have no words and fail the base rules; very long texts are counted whole; strata without labels keep
whatever passes the base rules; a null stratum is a stratum; rows whose label is null are no evidence; ties at a cutoff are
kept; repeated rows each get a row; a ``doc_id`` with several labels counts once for each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, own, read, slices

_BLANK = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_SIGNS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_POINTS = b"!?;:"
_STEP = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_points", "n_distinct")
#: Strata whose cutoffs are broadcast: some 500 bytes each.
BROADCAST_STRATA = 10_000
#: rule -> (counted, out of)
RULES = {
    "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "n_letters"), "points": ("n_points", "word_chars"), "sameness": ("n_same", "n_words"),
}


def steps(risk: float) -> list[tuple[float, float]]:
    """Shares of the proposing rows that a rule may reject, and margins on the cutoff that does, from mild to strict."""
    return [(0.0, 2 ** (k / 4)) for k in (4, 3, 2, 1, 0)] + [(risk / len(RULES) / 2**k, 1.0) for k in (3, 2, 1, 0)]


#: The acceptable share of good documents that rules reject, and the list that follows from it.
RISK = 0.03
STEPS = steps(RISK)


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int = 8) -> np.ndarray:
    """Words per document inside windows of ``size`` words that occur twice or more in it. ``words``: 64-bit hashes."""
    if len(words) < size:
        return np.zeros(n_docs, np.int64)
    key = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        key = (key ^ words[k : len(key) + k]) * _STEP
        key ^= key >> np.uint64(31)
    key = (key ^ doc[: len(key)].astype(np.uint64)) * _STEP
    at = np.flatnonzero(doc[: len(key)] == doc[size - 1 :])
    at = at[np.argsort(key[at], kind="stable")]
    same = key[at][1:] == key[at][:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + size, -1)
    return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n_docs)


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the counts of every whole text."""
    docs = own(docs, *keep, "text")
    last = len(keep)

    def count(batches):
        for batch in slices(batches, last):
            rows, hashes, sizes = [], [], []
            for text in batch.column(last).cast("binary").to_pylist():
                text = text or b""
                words = text.split()
                own_hashes = np.fromiter(map(hash, words), np.int64, len(words))
                hashes.append(own_hashes)
                sizes.append(len(words))
                lines = [x for x in text.split(b"\n") if x.strip()]
                drop = lambda chars, text=text: len(text) - len(text.translate(None, chars))
                rows.append((
                    len(words), len(text.translate(None, _CONTINUED + _BLANK)), drop(_SIGNS), len(lines) - len(set(lines)), 0, len(lines),
                    drop(_CAPITALS), drop(_CAPITALS + _SMALL), drop(_POINTS), len(set(words)),
                ))
            table = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            table[:, 4] = repeated_words(np.concatenate(hashes).view(np.uint64), doc, len(sizes)) if hashes else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *map(pa.array, table.T)], [*keep, *COUNTS])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(count, ", ".join([*(f"{c} {kinds[c]}" for c in keep), *(f"{c} long" for c in COUNTS)]))


def log_tail(k: int, n: int, p: float) -> float:
    """log P(at most k of n) when each has probability p."""
    if k >= n:
        return 0.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return top + log(sum(exp(t - top) for t in terms))


def certified(rejected: int, good: int, risk: float, delta: float) -> bool:
    """Whether the exact upper bound on the rejection rate, at confidence 1 - delta, is at most ``risk``."""
    if not good or rejected > risk * good:
        return False
    return log_tail(rejected, good, risk) <= log(delta)


def rate(rule: str) -> Column:
    """A rule's share in whole thousandths, rounded down."""
    part, whole = RULES[rule]
    part = F.col("n_words") - F.col("n_distinct") if part == "n_same" else F.col(part)
    return F.coalesce(F.floor(F.try_divide(1000 * part, F.col(whole))), F.lit(0))


def proposed(shares: dict[int, int], listed: list[tuple[float, float]]) -> list[int]:
    """The cutoff of each step for one rule, from the least share that leaves few enough rows above. ``shares``: share -> rows."""
    values = np.array(sorted(shares))
    rows = np.array([shares[v] for v in values.tolist()])
    above = rows.sum() - np.cumsum(rows)
    return [int(margin * values[np.argmax(above <= int(step * rows.sum()))]) for step, margin in listed]


def certified_step(rejected: dict[int, int], good: int, risk: float, delta: float, n_steps: int) -> int:
    """How many steps hold. ``rejected``: first step that rejects (1 for the mildest, 0 for none) -> rows."""
    total = 0
    for step in range(1, n_steps + 1):
        total += rejected.get(step, 0)
        if not certified(total, good, risk, delta):
            return step - 1
    return n_steps


def _first(rule: str) -> Column:
    """The first step whose cutoff the row is above; 0 if none."""
    return F.coalesce(F.array_position(F.transform(f"cuts.{rule}", lambda cut: rate(rule) > cut), F.lit(True)), F.lit(0))


def _with_cuts(rows: DataFrame, stratum: str, cuts: DataFrame, n_strata: int) -> DataFrame:
    return rows.join(F.broadcast(cuts) if n_strata <= BROADCAST_STRATA else cuts, F.col(stratum).eqNullSafe(F.col("s")), "left")


def certificates(counted: DataFrame, labels: DataFrame, stratum: str, risk: float, delta: float) -> tuple[DataFrame, int]:
    """For each stratum ``s``: its cutoffs by rule and step, the ``step`` certified (0 for none), the certifying rows and
    those of them that this step rejects; and the number of strata."""
    labels = own(labels, "doc_id", "quality").where("quality = 1").select(F.col("doc_id").alias("label_id"))
    good = counted.where("not base_failed").join(labels, F.col("doc_id") == F.col("label_id")).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    good = materialise(good.select(F.col(stratum).alias("stratum"), "half", *COUNTS))
    kind, listed = dict(counted.dtypes)[stratum], steps(risk)
    shares = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rate(r).alias("share")) for r in RULES])).alias("x")

    def propose(group):  # at most a thousand shares of each rule
        cuts = {rule: proposed(dict(zip(own_rows["share"].tolist(), own_rows["n"].tolist(), strict=True)), listed) for rule, own_rows in group.groupby("rule")}
        return pd.DataFrame({"s": group["stratum"].iloc[:1].tolist(), "cuts": [cuts]}, dtype=object)

    counts = good.where("half = 0").select("stratum", shares).groupBy("stratum", "x.rule", "x.share").agg(F.count("*").alias("n"))
    cuts = materialise(counts.groupBy("stratum").applyInPandas(propose, f"s {kind}, cuts struct<{', '.join(f'{r}: array<int>' for r in RULES)}>"))
    n_strata = cuts.count()
    firsts = [_first(r) for r in RULES]
    first = F.coalesce(F.least(*[F.when(x > 0, x) for x in firsts]), F.lit(0))
    judged = _with_cuts(good.where("half = 1"), "stratum", cuts, n_strata).select("stratum", F.coalesce(first, F.lit(0)).cast("int").alias("first"))
    tested = judged.groupBy("stratum", "first").agg(F.count("*").alias("n")).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("tested"))

    @F.udf("step int, good long, rejected long")
    def certify(found):  # once a stratum
        found = found or {}
        total = sum(found.values())
        step = certified_step(found, total, risk, delta / n_strata, len(listed))
        return step, total, sum(v for k, v in found.items() if 0 < k <= step)

    out = cuts.join(tested, F.col("s").eqNullSafe(F.col("stratum")), "left").select("s", "cuts", certify("tested").alias("c")).select("s", "cuts", "c.*")
    return materialise(out), n_strata


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = 0.05) -> DataFrame:
    """All documents with their counts, ``base_failed``, the first certified rule that rejects them, and ``kept``."""
    counted = materialise(measure(docs, "doc_id", stratum))
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    counted = counted.withColumn("base_failed", (words < 20) | (100 * repeats > 30 * words))
    found, n_strata = certificates(counted, labels, stratum, risk, delta)
    chosen = found.where("step > 0").select("s", F.struct(*[F.get(f"cuts.{r}", F.col("step") - 1).alias(r) for r in RULES]).alias("cuts"))
    joined = _with_cuts(counted, stratum, chosen, n_strata)
    reason = F.coalesce(F.when(F.col("base_failed"), "base"), *[F.when(rate(r) > F.col(f"cuts.{r}"), r) for r in RULES])
    return joined.withColumn("rejected_by", reason).withColumn("kept", reason.isNull()).drop("s", "cuts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
