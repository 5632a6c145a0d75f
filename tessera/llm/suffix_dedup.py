"""Removal of every byte covered by a ``length``-byte string that starts at two places or more, by a difference cover.

Suffixes are sampled at the positions whose residue modulo ``period`` is in a difference cover: for any two positions there
is a distance below ``period`` that takes both to samples. The three-residue cover of skewed suffix sorting samples two
thirds of all positions; strings of ``length`` bytes allow longer periods, and a perfect cover modulo 133 samples one in
eleven.

1. *Sort the samples' tuples.* A sample's tuple is its first ``length - period + 1`` bytes, which two starts of one repeated
   string always share at some sample. Tuples are sorted over the corpus; equal neighbours share a name, and a sample
   whose name is its own is told apart from all suffixes and leaves.
2. *Recurse on the names.* Samples with one name are named again by the wide string of all starts they stand for (``period
   - 1`` bytes before them to ``length`` after). A wide name that occurs twice settles all those starts at once.
3. *Merge the remaining suffixes.* The starts a sample stands for, samples and others alike, fall into ``PARTS`` ranges by
   their distance to it; what all strings of a range have in common is named too. Where several wide names share such a
   name and one of them is single, one sample of each gives the range's starts, to be sorted by their ``length`` bytes.
4. *Compare adjacent prefixes.* Equal neighbours are repeated. A settled sample stands there for all its equals.

Sorting is by digest, since only equality of neighbours counts: 48 bits and the bucket's of a tuple (a collision only
keeps a sample for longer), 40 bits beside the tuple's of a range (likewise), 79 bits and the bucket's of wide strings and
prefixes, taken as equal strings.

Texts are written once, in slices of some megabytes; a slice and a bucket of digests exchange one block of bytes a step,
in which what the slice repeats stands once, so a passage that a third of all documents share weighs as many entries as
there are slices. Answers are bits; they are joined to the slices without moving the texts.

Null and empty texts have no bytes; matches never cross documents; a text longer than a slice is a slice of its own (up to
2 GB); rows that share ``doc_id`` and text are two occurrences of it; ties need no order; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, own, parallelism, read, shared_dir, slices

#: Perfect difference covers by period (fixed values): every residue is the difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)}
SLICE = 8 << 20
PARTS = 4
#: Digests that a task sorts at once, about.
SORTED_TOGETHER = 1_000_000
#: Digests that are computed in one go.
PIECE = 1 << 16
_LOW48, _LOW15 = np.uint64((1 << 48) - 1), np.uint64((1 << 15) - 1)
TEXTS = "home int, slice long, ids array<long>, sizes array<int>, data binary"
ASKED = "bucket int, home int, slice long, block binary"
ANSWERED = "bucket int, home int, slice long, bits binary"
#: A row group for each slice: a reader holds one slice, however many its file has.
ROW_GROUPS = {"parquet.block.size": 1, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.writer.max-padding": 0}


@contextlib.contextmanager
def _few_at_once(spark: SparkSession):
    """While this lasts, Arrow batches end with the first row beyond a slice's size, and a task writes its one bucket as
    its rows come instead of sorting them first."""
    limits = {"spark.sql.execution.arrow.maxBytesPerBatch": SLICE, "spark.sql.maxConcurrentOutputFileWriters": 1}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def period_for(length: int) -> int:
    """The longest period that leaves a tuple a third of ``length``."""
    fitting = [p for p in COVERS if 3 * p <= 2 * length]
    if not fitting:
        raise ValueError(f"length must be at least {-(-3 * min(COVERS) // 2)}")
    return max(fitting)


class Slice:
    """The texts of a slice end to end, their samples and, step by step, what is known of them."""

    def __init__(self, sizes: np.ndarray, data, length: int):
        self.view, self.length = memoryview(data), length
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.period = period_for(length)
        cover = np.array(COVERS[self.period], np.int64)
        at = (np.arange(0, len(self.view), self.period)[:, None] + cover).ravel()
        at = at[at < len(self.view)]
        doc = np.searchsorted(self.ends, at, "right")
        first, last = np.maximum(self.starts[doc], at - self.period + 1), np.minimum(self.ends[doc] - length, at)
        some = first <= last  # the sample stands for a start whose string lies in the text
        self.at, self.first, self.last = at[some], first[some], last[some]

    def tuples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests of the distinct tuples, sorted; each sample's place among them; how often each occurs."""
        found = _short(self.view, self.at, self.at + self.length - self.period + 1)
        return np.unique(found, return_inverse=True, return_counts=True)

    def keep(self, which: np.ndarray, names: np.ndarray) -> None:
        self.at, self.first, self.last, self.names = self.at[which], self.first[which], self.last[which], names[which]

    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (name, wide digest) of the kept samples: their entries, sorted, and each sample's place among them."""
        high, low = _digests(self.view, self.first, self.last + self.length, self.at - self.first)
        return _distinct(self.names, high, low)

    def range_of(self, part: int) -> tuple[int, int]:
        """The least and largest distance of a range's starts to their sample."""
        return part * self.period // PARTS, (part + 1) * self.period // PARTS - 1

    def common(self, place: np.ndarray) -> np.ndarray:
        """For each entry and range: the digest of what the range's strings have in common, where it has a start."""
        chosen = np.unique(place, return_index=True)[1]
        at, first, last = self.at[chosen], self.first[chosen], self.last[chosen]
        out = np.zeros((len(chosen), PARTS), np.uint64)
        for part in range(PARTS):
            near, far = self.range_of(part)
            some = (at - last <= far) & (at - first >= near)
            out[some, part] = _short(self.view, at[some] - near, at[some] - far + self.length)
        return out

    def prefixes(self, chosen: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The starts that the listed samples stand for in their wanted ranges, and their distinct digests."""
        found = [np.zeros(0, np.int64)]
        for part in range(PARTS):
            near, far = self.range_of(part)
            own = chosen[wanted[:, part]]
            low, high = np.maximum(self.first[own], self.at[own] - far), np.minimum(self.last[own], self.at[own] - near)
            counts = np.maximum(high - low + 1, 0)
            found.append(np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum()))
        at = np.unique(np.concatenate(found))
        high, low = _digests(self.view, at, at + self.length)
        return at, _distinct(low, high, low)


def _short(view: memoryview, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of stretches of ``view``."""
    out, digest = np.empty(len(begin), np.uint64), xxhash.xxh3_64_intdigest
    for k in range(0, len(begin), PIECE):
        spans = zip(begin[k : k + PIECE].tolist(), end[k : k + PIECE].tolist(), strict=True)
        out[k : k + PIECE] = [digest(view[a:b]) for a, b in spans]
    return out


def _digests(view: memoryview, begin: np.ndarray, end: np.ndarray, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of stretches of ``view`` as high and low halves."""
    both, digest = np.empty((len(begin), 2), np.uint64), xxhash.xxh3_128_digest
    for k in range(0, len(begin), PIECE):
        spans = zip(begin[k : k + PIECE].tolist(), end[k : k + PIECE].tolist(), repeat(0) if seeds is None else seeds[k : k + PIECE].tolist(), strict=False)
        both[k : k + PIECE] = np.frombuffer(b"".join([digest(view[a:b], seed) for a, b, seed in spans]), ">u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


ENTRY = np.dtype([("route", "<u8"), ("low", "<u8"), ("high", "<u2"), ("common", "<u8", (PARTS,))])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def _distinct(route: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct entries and each row's place among them. The top bit of ``high`` tells that an entry occurs twice."""
    high = high & _LOW15
    order = np.lexsort((high, low, route))
    new = _changes(route[order], low[order], high[order])
    group = np.cumsum(new) - 1
    place = np.empty(len(order), np.int64)
    place[order] = group
    out = np.zeros(int(new.sum()), ENTRY)
    firsts = order[new]
    out["route"], out["low"] = route[firsts], low[firsts]
    out["high"] = high[firsts] | ((np.bincount(group, minlength=len(out)) > 1).astype(np.uint64) << np.uint64(15))
    return out, place


def _bucket(route: np.ndarray, buckets: int) -> np.ndarray:
    """By the top bits, so sorted routes give sorted buckets."""
    return ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bytes(x: np.ndarray, width: int) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _number(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view("<u8").ravel().astype(np.uint64)


#: The exchanges between slices and buckets: bytes of an entry, bits of its answer.
STEPS = TUPLES, WIDE, PREFIXES = 0, 1, 2
_WIDTH, _BITS = (6, 16 + 5 * PARTS, 10), (1, 1 + PARTS, 1)


def _encode(step: int, entries: np.ndarray) -> np.ndarray:
    if step == TUPLES:
        return _bytes(entries & _LOW48, 6)
    tail = [_bytes(entries["low"], 8), _bytes(entries["high"], 2)]
    common = [_bytes(entries["common"][:, k], 5) for k in range(PARTS)]
    return np.hstack([*common, _bytes(entries["route"] & _LOW48, 6), *tail] if step == WIDE else tail)


def _judge(step: int, rows: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The answers (rows x bits) to a bucket's entries."""
    if step == TUPLES:
        name = _number(rows)
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        out = np.zeros((len(rows), 1), bool)
        out[order[1:][same]] = out[order[:-1][same]] = True
        return out
    name = _number(rows[:, -16:-10]) if step == WIDE else np.zeros(len(rows), np.uint64)
    low, high = _number(rows[:, -10:-2]), _number(rows[:, -2:])
    twice, high = high >> np.uint64(15), high & _LOW15
    order = np.lexsort((high, low, name))
    new = _changes(name[order], low[order], high[order])
    group = np.cumsum(new) - 1
    repeated = np.bincount(group, 1.0 + twice[order]) > 1
    out = np.zeros((len(rows), _BITS[step]), bool)
    out[order, 0] = repeated[group]
    if step == WIDE:
        # the first of each wide name is compared in a range where others have the same in common, if any of them is single
        firsts = order[new]
        for part in range(PARTS):
            common, owner = _number(rows[firsts][:, 5 * part : 5 * part + 5]), name[firsts]
            by = np.lexsort((common, owner))
            shared = np.cumsum(_changes(owner[by], common[by])) - 1
            mixed = (np.bincount(shared) > 1) & (np.bincount(shared, ~repeated[by]) > 0)
            out[firsts[by], 1 + part] = mixed[shared]
    return out


def _ask(step: int, home: int, number: int, entries: np.ndarray, buckets: int):
    """Record batch of a slice's blocks."""
    route = entries if step == TUPLES else entries["route"]
    bucket, coded = _bucket(route, buckets), _encode(step, entries)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    blocks = [coded[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    n = len(blocks)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]].astype(np.int32) if n else np.zeros(0, np.int32)), pa.array(np.full(n, home, np.int32)), pa.array(np.full(n, number, np.int64)), pa.array(blocks, pa.binary())],
        ["bucket", "home", "slice", "block"],
    )


def _heard(step: int, entries: np.ndarray, buckets: int, answers: list[dict]) -> np.ndarray:
    """Answers to a slice's entries, from the bits of its buckets."""
    route = entries if step == TUPLES else entries["route"]
    counts = dict(zip(*(x.tolist() for x in np.unique(_bucket(route, buckets), return_counts=True)), strict=True))
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=counts[a["bucket"]] * _BITS[step]) for a in sorted(answers, key=lambda a: a["bucket"])]
    return np.concatenate([np.zeros(0, np.uint8), *parts]).reshape(-1, _BITS[step]).astype(bool)


def _answers(asked: DataFrame, step: int) -> DataFrame:
    """(bucket, home, slice, bits): each bucket's entries sorted and compared in one task."""

    def judge(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, _WIDTH[step]) for x in table.column("block")]
        sizes = [len(x) for x in blocks]
        out = _judge(step, np.concatenate(blocks), np.repeat(np.arange(len(blocks)), sizes))
        bits = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
        return table.drop_columns("block").append_column("bits", pa.array(bits, pa.binary()))

    return asked.groupBy("bucket").applyInArrow(judge, ANSWERED)


def _fields(batch: pa.RecordBatch, *names: str):
    """The rows' values one row at a time, texts without a copy."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].as_buffer() if c == "data" else batch.column(c)[i].as_py() for c in names)


class _Corpus:
    """The slices, and the answers they have had."""

    def __init__(self, docs: DataFrame, length: int):
        self.spark, self.length, self.heard = docs.sparkSession, length, []
        self.name = f"slices_{uuid.uuid4().hex}"
        self._write(docs)
        size = self.texts.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0))).first()[0]
        period = period_for(length)
        self.buckets = max(3 * parallelism(self.spark), size * len(COVERS[period]) // period // SORTED_TOGETHER + 1)

    def _write(self, docs: DataFrame) -> None:
        """Each task gives its slices one home, so that it writes one file, and homes are the table's buckets: joins on
        the home leave the texts where they are."""
        n = parallelism(self.spark)
        homes = self.spark.range(64 * n).select(F.col("id").cast("int").alias("home")).withColumn("b", F.pmod(F.hash("home"), F.lit(n)))
        homes = [r["home"] for r in homes.groupBy("b").agg(F.min("home").alias("home")).collect()]  # one for each partition

        def cut(batches):
            task, k = TaskContext.get().partitionId(), 0
            for batch in slices(batches, 1, SLICE):
                texts = [x or b"" for x in batch.column(1).cast("binary").to_pylist()]
                ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0))
                row = [pa.array([homes[task % len(homes)]], pa.int32()), pa.array([(task << 32) + k]), ids, pa.array([[len(x) for x in texts]], pa.list_(pa.int32())), pa.array([b"".join(texts)], pa.binary())]
                k += 1
                yield pa.RecordBatch.from_arrays(row, ["home", "slice", "ids", "sizes", "data"])

        cut = docs.mapInArrow(cut, TEXTS)
        cut.write.bucketBy(n, "home").options(path=shared_dir(self.spark), compression="zstd", **ROW_GROUPS).format("parquet").saveAsTable(self.name)
        self.texts = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table {self.name}")

    def with_answers(self) -> DataFrame:
        """The slices with ``answers``, an array of (step, bucket, bits)."""
        none = F.expr("cast(array() as array<struct<step: int, bucket: int, bits: binary>>)")
        if not self.heard:
            return self.texts.withColumn("answers", none)
        heard = self.heard[0]
        for more in self.heard[1:]:
            heard = heard.union(more)
        # a row for each slice on its home's partition; the slices are compared beside the join's key, which is the home
        heard = heard.repartition(parallelism(self.spark), "home").groupBy("home", "slice").agg(F.collect_list(F.struct("step", "bucket", "bits")).alias("mine"))
        heard = heard.withColumnRenamed("slice", "answered").hint("shuffle_hash")
        own_slice = (F.col("slice") <= F.col("answered")) & (F.col("slice") >= F.col("answered"))
        joined = self.texts.alias("t").join(heard.alias("h"), (F.col("t.home") == F.col("h.home")) & own_slice, "left")
        return joined.select("t.*", F.coalesce("mine", none).alias("answers"))

    def _known(self):
        """Function of a row: the slice as far as the answers go, and the entries it asks for next."""
        length, buckets = self.length, self.buckets

        def known(sizes: list[int], data: pa.Buffer, answers: list[dict]):
            mine = [[a for a in answers if a["step"] == k] for k in STEPS]
            s = Slice(np.array(sizes, np.int64), data, length)
            names, place, times = s.tuples()
            s.covered = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if not mine[0]:
                return s, names
            repeated = _heard(TUPLES, names, buckets, mine[0])[:, 0] | (times > 1)
            s.keep(repeated[place], names[place])
            entries, place = s.wide()
            if not mine[1]:
                entries["common"] = s.common(place)
                return s, entries
            answer = _heard(WIDE, entries, buckets, mine[1])
            settled, wanted = answer[:, 0], answer[:, 1:]
            s.covered = (s.first[settled[place]], s.last[settled[place]])
            chosen = np.unique(place, return_index=True)[1]  # a sample for each entry
            at, (entries, place) = s.prefixes(chosen, wanted)
            if mine[2]:
                again = _heard(PREFIXES, entries, buckets, mine[2])[place, 0]
                s.covered = tuple(np.concatenate([x, at[again]]) for x in s.covered)
            elif any(settled):
                # a settled sample's starts are repeated whoever else has them
                marks = np.zeros(len(at) + 1, np.int64)
                np.add.at(marks, np.searchsorted(at, s.covered[0]), 1)
                np.add.at(marks, np.searchsorted(at, s.covered[1], "right"), -1)
                entries["high"][place[np.cumsum(marks)[:-1] > 0]] |= np.uint16(1 << 15)
            return s, entries

        return known

    def exchange(self, step: int) -> None:
        """The slices ask, the buckets answer."""
        known, buckets = self._known(), self.buckets

        def ask(batches):
            for batch in batches:
                for home, number, sizes, data, answers in _fields(batch, "home", "slice", "sizes", "data", "answers"):
                    if step and not any(a["step"] == step - 1 for a in answers):
                        continue  # nothing was asked before
                    _, entries = known(sizes, data, answers)
                    yield _ask(step, home, number, entries, buckets)

        asked = self.with_answers().mapInArrow(ask, ASKED)
        self.heard.append(materialise(_answers(asked, step).withColumn("step", F.lit(step))))

    def result(self, keep_text: bool) -> DataFrame:
        known, length = self._known(), self.length

        def cut(batches):
            for batch in batches:
                for ids, sizes, data, answers in _fields(batch, "ids", "sizes", "data", "answers"):
                    s, _ = known(sizes, data, answers)
                    yield _cut(s, ids, length, keep_text)

        return self.with_answers().mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _cut(s: Slice, ids: list, length: int, keep_text: bool):
    """Rows of the slice's documents without the bytes of the covered starts."""
    first, last = s.covered
    order = np.lexsort((last, first))
    a, b = first[order], last[order] + length
    doc = np.searchsorted(s.ends, a, "right")
    far = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] > far[:-1]) | (doc[1:] != doc[:-1])  # spans that touch are one
    stops = np.append(far[:-1][new[1:]], far[-1:])
    spans: dict[int, list] = {}
    for d, x, y in zip(doc[new].tolist(), a[new].tolist(), stops.tolist(), strict=True):
        spans.setdefault(d, []).append((x, y))
    out = []
    for d, (doc_id, x, y) in enumerate(zip(ids, s.starts.tolist(), s.ends.tolist(), strict=True)):
        kept, at = [], x
        for i, j in spans.get(d, ()):
            kept.append(s.view[at:i])
            at = j
        rest = b"".join([*kept, s.view[at:y]])
        out.append((doc_id, y - x, y - x - len(rest), len(spans.get(d, ())), hashlib.sha256(rest).hexdigest(), rest if keep_text and d in spans else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = zip(*out, strict=True) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame, length: int = 200, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; ``kept``: the bytes left of a text that lost
    some (null without ``keep_text``)."""
    with _few_at_once(docs.sparkSession):
        corpus = _Corpus(own(docs, "doc_id", "text"), length)
        try:
            for step in STEPS:
                corpus.exchange(step)
            return materialise(corpus.result(keep_text))
        finally:
            corpus.drop()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"), keep_text=False).drop("kept")
