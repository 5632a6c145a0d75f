"""Benchmark decontamination: windows of benchmark words are looked up in every document.

Words are runs of characters other than ASCII signs, A to Z in lower case. A window is ``n`` consecutive words of an
item; an item of fewer words is one window. Document words inside an occurrence of a window are hit. Up to
``broadcast_words`` benchmark words travel to the tasks as a hash set with the windows to verify hits against; beyond
that, windows of both sides are joined by their hash.

Null texts have no words and are not contaminated; items without words or without an id are ignored; items that share an
id count once; repeated documents each get their row; very long texts are looked up whole, a slice alone; ties do not
arise (items are a set); extra columns are ignored; an empty table of documents gives an empty result, an empty benchmark
no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, own, read, slices, without

#: Per byte: lower case for A to Z, a blank for ASCII other than letters and digits, bytes of longer characters as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each row of word numbers."""
    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        out = (out ^ column.astype(np.uint64)) * _STEP
        out ^= out >> np.uint64(29)
    return out


class WindowSet:
    """Windows of the items by length, with the items of each, and the words they are made of."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            own_words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words((text or "").encode())]
            size = min(n, len(own_words))
            for i in range(len(own_words) - size + 1 if size else 0):
                found[size][tuple(own_words[i : i + size])].add(str(item))
        self.tables = []
        for size, windows in found.items():
            rows = np.array(list(windows), np.int32).reshape(-1, size)
            order = np.argsort(keys := _keys(rows), kind="stable")
            owners = [sorted(x) for x in windows.values()]
            self.tables.append((size, keys[order], rows[order], [owners[i] for i in order]))

    def scan(self, texts: list[bytes | None]):
        """Per text: its number of words, the places of words that are hit, and the items that occur."""
        numbers, counts = [0], []
        for text in texts:
            own_words = words(text or b"")
            numbers.extend(map(self.vocabulary.get, own_words, repeat(0)))
            numbers.append(0)
            counts.append(len(own_words))
        ids = np.array(numbers, np.int32)
        firsts = 1 + np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])[:-1]
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        cover, owners = np.zeros(len(ids) + 1, np.int32), defaultdict(set)
        for size, keys, rows, items in self.tables:
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            for part in np.array_split(at, max(1, len(at) // 500_000)):
                seen = ids[part[:, None] + np.arange(size)]
                k = np.minimum(np.searchsorted(keys, key := _keys(seen)), len(keys) - 1)
                while len(part):  # windows with equal keys lie side by side
                    same = keys[k] == key
                    part, seen, k, key = part[same], seen[same], k[same], key[same]
                    for p, w in zip(*((x[(rows[k] == seen).all(axis=1)]).tolist() for x in (part, k)), strict=True):
                        cover[p] += 1
                        cover[p + size] -= 1
                        owners[int(np.searchsorted(firsts, p, "right")) - 1].update(items[w])
                    more = k + 1 < len(keys)
                    part, seen, k, key = part[more], seen[more], k[more] + 1, key[more]
        hit = np.cumsum(cover)[:-1] > 0
        for row, (first, count) in enumerate(zip(firsts.tolist(), counts, strict=True)):
            yield count, np.flatnonzero(hit[first : first + count]), owners.get(row, set())


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _broadcast(docs: DataFrame, items: list[tuple[int, str]], n: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))

    def scan(batches):
        for batch in slices(batches, 1):
            out = [(c, len(hit), len(items), digest(items), len(hit) > 0) for c, hit, items in shared.value.scan(batch.column(1).cast("binary").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(scan, RESULT)


def _window_rows(texts: DataFrame, n: int, sizes: list[int] | None) -> DataFrame:
    """(row, place, window): all windows of ``sizes`` words; of an item (no sizes) those of ``n`` or all its words."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = texts.withColumn("words", F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""))
    split = split.withColumn("size", F.explode(F.array(*map(F.lit, sizes))) if sizes else F.least(F.lit(n), F.size("words")))
    split = split.where("size > 0 and size(words) >= size").withColumn("place", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    return split.withColumn("window", F.slice("words", F.col("place"), F.col("size"))).drop("text", "words")


def _joined(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The same result for a benchmark of any size: windows meet in a join on their hash, and those that do on their words."""
    item_windows = materialise(_window_rows(benchmark, n, None).select(F.col("item_id").cast("string").alias("item_id"), "window", F.xxhash64("window").alias("key")).distinct())
    sizes = sorted(r[0] for r in item_windows.select(F.size("window")).distinct().collect())  # at most n numbers
    numbered = materialise(docs.withColumn("row", F.monotonically_increasing_id()))
    counted = _window_rows(numbered, n, [1]).groupBy("row").agg(F.count("*").alias("n_words"))
    found = numbered.limit(0).select("row", F.lit("").alias("item_id"), F.lit(1).alias("place"), F.lit(1).alias("size"))
    if sizes:
        # hashes and places travel; the few whose hash is an item's are read again with their words
        keys = item_windows.select("key").distinct()
        places = _window_rows(numbered, n, sizes).select("row", "size", "place", F.xxhash64("window").alias("key"))
        near = materialise(places.join(keys, "key", "left_semi").groupBy("row").agg(F.collect_set(F.struct("size", "place")).alias("near")))
        read_again = numbered.join(near, "row").select("row", "text", F.explode("near").alias("at"))
        wanted = _window_rows(read_again, n, sizes).where("size = at.size and place = at.place").withColumn("key", F.xxhash64("window"))
        found = materialise(wanted.join(item_windows, ["key", "window"]).select("row", "item_id", "place", "size"))
    hits = found.select("row", F.explode(F.sequence("place", F.col("place") + F.col("size") - 1)).alias("hit")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    items = found.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = numbered.select("row", "doc_id").join(counted, "row", "left").join(hits, "row", "left").join(items, "row", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: Benchmark words that may travel to every task: a window takes some 400 bytes there, so 80 MB at most.
BROADCAST_WORDS = 200_000


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document; see the module's text."""
    items = own(benchmark, "item_id", "text").where("item_id is not null")
    docs = own(docs, "doc_id", "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size <= 4 * broadcast_words:
        return _broadcast(docs, [tuple(r) for r in items.collect()], n)
    return _joined(docs, items, n)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents no window occurs in, with all their columns."""
    return without(docs, contamination(docs, benchmark, n, broadcast_words).where("contaminated").select("doc_id").distinct())


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Documents with the hit words removed from their texts; other columns stay. A benchmark of more words than may be
    broadcast raises an error: cut it into parts and remove the spans of each."""
    import re

    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > 4 * broadcast_words:
        raise ValueError(f"the benchmark has about {size // 5} words; at most {broadcast_words} may be broadcast")
    items = [tuple(r) for r in own(benchmark, "item_id", "text").where("item_id is not null").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))
    pattern, at = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), docs.columns.index("text")

    def cut(batches):
        for batch in slices(batches, at):
            texts, out = batch.column(at).cast("binary").to_pylist(), []
            for text, (_, hit, _) in zip(texts, shared.value.scan(texts), strict=True):
                if len(hit):
                    spans = [m.span() for m in pattern.finditer(text.lower())]
                    gone = bytearray(text)
                    for i in reversed(hit.tolist()):
                        a, b = spans[i][0], spans[i + 1][0] if i + 1 in set(hit.tolist()) else spans[i][1]
                        del gone[a:b]
                    text = bytes(gone)
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()).cast(batch.schema.field(at).type))

    return docs.mapInArrow(cut, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
