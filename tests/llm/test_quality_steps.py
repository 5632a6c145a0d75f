"""The list of steps, cutoffs kept as a table, and false rejections for each stratum on labels never used."""

import math

from test_operators import LARGE, read

from tessera.llm import quality


def test_steps_follow_from_the_risk():
    for risk in (0.01, 0.03, 0.2):
        found = quality.steps(risk)
        assert [m for share, m in found if not share] == sorted((m for share, m in found if not share), reverse=True)
        assert [s for s, _ in found] == sorted(s for s, _ in found)
        assert math.isclose(found[-1][0] * len(quality.RULES), risk) and found[-1][1] == 1.0


def test_joined_cutoffs_give_the_same(spark, monkeypatch):
    docs, labels = read(spark, LARGE, "documents"), read(spark, LARGE, "labels")
    want = {r["doc_id"]: (r["kept"], r["rejected_by"]) for r in quality.verdicts(docs, labels).collect()}
    monkeypatch.setattr(quality, "BROADCAST_STRATA", 0)
    assert {r["doc_id"]: (r["kept"], r["rejected_by"]) for r in quality.verdicts(docs, labels).collect()} == want


def test_false_rejections_of_each_stratum(spark):
    """Cutoffs from two thirds of the labels; what they reject of the rest must not contradict the risk in any language."""
    labels = read(spark, LARGE, "labels")
    unseen = {r["doc_id"] for r in labels.where("quality = 1 and crc32(cast(doc_id as string)) % 3 = 1").collect()}
    out = quality.verdicts(read(spark, LARGE, "documents"), labels.where("crc32(cast(doc_id as string)) % 3 <> 1")).where("not base_failed").collect()
    for lang in {r["lang"] for r in out}:
        own = [not r["kept"] for r in out if r["lang"] == lang and r["doc_id"] in unseen]
        n, k = len(own), sum(own)
        above = sum(math.comb(n, i) * quality.RISK**i * (1 - quality.RISK) ** (n - i) for i in range(k, n + 1))
        assert above > 0.001, (lang, k, n)


def test_a_null_stratum_and_one_without_labels(spark):
    text = "some good words of a text that has more than twenty of them so that it passes all the base rules of the list at once {}"
    bad = "WORDS !!! ### ??? " * 3 + " ".join(f"X{i}!" for i in range(40))
    rows = [(i, text.format(i), None) for i in range(700)] + [(10_000, bad, None), (10_001, bad, "none"), (10_002, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(700)], "doc_id long, quality int")
    found = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality.verdicts(docs, labels).collect()}
    assert len(found) == 703 and not found[10_000][0] and not found[10_000][1] and found[10_001][0] and found[10_002] == (False, True)
    assert all(found[i][0] for i in range(700))
