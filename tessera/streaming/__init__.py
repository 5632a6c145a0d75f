"""Scoring of streams: prediction is a projection without state, so it runs on a streaming DataFrame as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.operators import scoring
from tessera.sources import shared_folder


def score_stream(model: DataFrame, stream: DataFrame, family: str, **options) -> DataFrame:
    return scoring.predict(family, model, stream, **options)


def arriving(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_a_batch: int = 100) -> DataFrame:
    """The Parquet files of a table as a stream; a pattern of the one name, since a plain path has to be a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{folder}/{name}.par[q]uet")


def scored_files(model: DataFrame, stream: DataFrame, family: str, to: str | None = None, batches: int | None = None, **options) -> DataFrame:
    """Scores what has arrived, writes it to the Parquet sink ``to`` and returns what the sink holds. The checkpoint lies
    beside it: a call with the same ``to`` goes on where the last one ended or broke off, with no row lost or written
    twice. ``batches``: the call ends after so many."""
    to = to or shared_folder(stream.sparkSession)
    scored = score_stream(model, stream, family, **options)
    query = scored.writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
    if batches is not None:
        while query.isActive and len([p for p in query.recentProgress if p.numInputRows]) < batches:
            query.awaitTermination(1)
        query.stop()
    query.awaitTermination()
    return stream.sparkSession.read.schema(scored.schema).parquet(f"{to}/rows")
