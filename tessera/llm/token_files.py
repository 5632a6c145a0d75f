"""Token-id files: Parquet list columns in ascending document order, read back selectively.

A file holds a range of ``doc_id``; each row has the document's ids, its place within the file and the ids before it in
the file. ``doc_id`` is sorted, so row-group and page indexes let a reader fetch the ids of a few documents, and metadata
columns are read without the ids.

Null and empty texts hold their end id alone; very long texts are encoded whole, one to a slice; null ``doc_id`` come
first; rows with the same ``doc_id`` are all kept, in the order of their texts' hashes, and may lie in several files;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own, parallelism, read, shared_dir, slices
from .tokens import encoder

FILE = "doc_id long, ids array<int>, n_tokens int, part int, place long, before long"
#: How ids are laid out: a dictionary for each row group, or deltas in packed blocks.
LAYOUTS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0", "parquet.dictionary.page.size": 1 << 20},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, layout: str = "dictionary", row_group_mb: int = 16, page_rows: int = 2000, file_mb: int = 256) -> None:
    """Encode every text and write the files. Texts are sorted before they are encoded, so they are encoded once. Files
    hold about ``file_mb`` MB of text each; small inputs are dealt to as many files as the session has shuffle partitions."""

    def encode(batches):
        coder, part, place, before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, 1):
            bounds, ids = coder.encode(batch.column(1), end_id)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(np.diff(bounds).astype(np.int32)),
                    pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(before + bounds[:-1]),
                ],
                ["doc_id", "ids", "n_tokens", "part", "place", "before"],
            )
            place, before = place + n, before + int(bounds[-1])

    docs = own(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(parallelism(docs.sparkSession), -(-size // (file_mb << 20)))
    ordered = docs.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    options = LAYOUTS[layout] | {"parquet.block.size": row_group_mb << 20, "parquet.page.row.count.limit": page_rows, "compression": "zstd"}
    ordered.mapInArrow(encode, FILE).write.options(**options).parquet(path)


def read_ids(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The files' rows; with bounds, only row groups and pages that can hold such documents are read."""
    rows = spark.read.schema(FILE).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def summarise(rows: DataFrame) -> DataFrame:
    """Per document: the ids before it over all files, its number of ids and their checksum, all from the files."""

    def check(batches):
        for batch in batches:
            lists = batch.column(1)
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            at = lists.offsets.to_numpy().astype(np.int64)
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(at)), pa.array(sums, pa.int64())], ["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    read_back = rows.select("doc_id", "ids", "part", "before").mapInArrow(check, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    # one row per file
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return read_back.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_ids(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return summarise(read_ids(spark, path))
