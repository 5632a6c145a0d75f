"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of "words" in the shingle and quality operators: space, tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: an array expression used inside a lambda would otherwise be
    computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` wins. Where none is configured, a local session gets a temporary folder; on a
    cluster the executors could not share one, so that is an error.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own(df: DataFrame, *needed: str) -> DataFrame:
    """Only the columns an operator works on, so that clashing extra columns cannot disturb it."""
    return df.select(*[df[c] for c in needed])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is none of the distinct ids in the one column of ``ids``; null is an id."""
    gone = ids.toDF(free_name(docs, "gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(gone.columns[0])), "left_anti")


def slices(batches, column: int, budget: int = 6 << 20):
    """Cut Arrow record batches so that a slice holds about ``budget`` bytes of text; a longer text stands alone."""
    import numpy as np

    for batch in batches:
        sizes = np.asarray(batch.column(column).fill_null("").cast("binary").to_pandas().str.len(), dtype=np.int64)
        groups, start = np.cumsum(sizes) // budget, 0
        for stop in [*(np.flatnonzero(np.diff(groups)) + 1), batch.num_rows]:
            if stop > start:
                yield batch.slice(start, stop - start)
            start = int(stop)
