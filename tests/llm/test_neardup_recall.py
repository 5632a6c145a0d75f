"""Every document of sf0.1 whose id is divisible by 50, against all rows by brute force: linked texts share a component."""

import re

import pyarrow.parquet as pq
from test_operators import LARGE

from tessera.llm import neardup


def shingles(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} if words else set()


def test_no_link_of_the_query_set_is_missed(spark):
    table = pq.read_table(f"{LARGE}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sets = {r["doc_id"]: shingles(r["text"]) for r in table}
    found = {r["doc_id"]: r for r in neardup.query(spark, LARGE).collect()}
    assert {k: found[k]["n_shingles"] for k in sets} == {k: len(x) for k, x in sets.items()}
    links = 0
    for k, own in sets.items():
        if k % 50 or not own:
            continue
        for other, theirs in sets.items():
            if other != k and 4 * len(own) <= 5 * len(theirs) and 4 * len(theirs) <= 5 * len(own) and theirs:
                both = len(own & theirs)
                if 100 * both >= 80 * (len(own) + len(theirs) - both):
                    links += 1
                    assert found[k]["component_id"] == found[other]["component_id"] <= min(k, other)
    assert links > 100
