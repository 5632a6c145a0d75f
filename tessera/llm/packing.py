"""Best-fit packing of token pieces into fixed-length sequences, planned on the histogram of lengths.

Only the counts of the at most ``capacity`` lengths reach the driver. Best-fit decreasing runs over those counts, a step
for a whole run of equal sequences at a time, and gives intervals of ranks: "pieces of this length with ranks a to b go
to sequences s, s+1, ... at this offset". Pieces then find their slot by a join on their rank within their length.

Null and empty texts are packed as their end id alone; very long texts are cut into pieces of ``capacity`` ids; repeated
rows are packed as often as they occur; pieces of equal length are ranked by hash, then by their columns, and which of
two equal ones takes a slot is open; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, own, read, slices
from .tokens import encoder

#: Rows that share one ranking task at most, about.
RANKED_TOGETHER = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: texts longer than ``capacity`` ids are cut from the end, so the first piece may be shorter."""

    def cut(batches):
        coder = encoder(vocabulary)
        for batch in slices(batches, 1):
            bounds, ids = coder.encode(batch.column(1), end_id)
            raw, rows = memoryview(ids.astype("<u4").tobytes()), []
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                stops = [*range(a + ((b - a) % capacity or capacity), b, capacity), b]
                for k, (x, y) in enumerate(zip([a, *stops], stops, strict=False)):
                    rows.append((row, k, x - a, y - x, zlib.crc32(raw[4 * x : 4 * y])))
            table = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *map(pa.array, table[:, 2:].T)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return own(docs, "doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, first sequence, offset).

    Sequences with equal room are kept as runs of ids, so a step places as many pieces as the run or the count holds.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms = made = 0  # rooms: bit r is set while a sequence has room r

    def put(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if room and n:
            runs[room].append((first, n))
            rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if fitting := rooms >> length:
                room = length + (fitting & -fitting).bit_length() - 1
                first, n = runs[room].pop()
                take = min(n, left)
                put(room, first + take, n - take)
                if not runs[room]:
                    rooms &= ~(1 << room)
                plan.append((length, rank, take, first, capacity - room))
                put(room - length, first, take)
                rank, left = rank + take, left - take
            else:
                each = min(capacity // length, left)
                n = left // each
                for k in range(each):
                    plan.append((length, rank + k * n, n, made, k * length))
                put(capacity - each * length, made, n)
                made, rank, left = made + n, rank + each * n, left - each * n
    return plan


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (any rows with ``doc_id``, ``piece``, ``start``, ``length``)."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = best_fit(histogram, capacity)
    # Intervals are found by an equality join on blocks of ranks, as many blocks a length as it has intervals.
    intervals = defaultdict(int)
    for length, *_ in plan:
        intervals[length] += 1
    width = {n: -(-histogram[n] // intervals[n]) for n in intervals}
    slots = [(n, b, *rest) for n, *rest in plan for b in range(rest[0] // width[n], (rest[0] + rest[1] - 1) // width[n] + 1)]
    slots = spark.createDataFrame(slots, "length long, block long, first_rank long, ranks long, first_sequence long, slot_offset long")
    widths = spark.createDataFrame(list(width.items()), "length long, width long")

    buckets = max(1, sum(histogram.values()) // RANKED_TOGETHER)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
        .drop("n").join(F.broadcast(widths), "length")
    )
    order = Window.partitionBy("length", "bucket").orderBy(*[c for c in cut.columns if c != "length"])
    ranked = dealt.withColumn("within", F.row_number().over(order)).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within") - 1).withColumn("block", F.floor(F.col("rank") / F.col("width")))
    # The plan has a few rows for each length, whatever the number of documents.
    placed = ranked.join(F.broadcast(slots), ["length", "block"]).where("rank >= first_rank and rank < first_rank + ranks")
    return placed.select(
        *cut.columns,
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        F.col("slot_offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    return pack(materialise(pieces(docs, vocabulary, end_id, capacity)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
