"""Where models read from and are saved to: a DataFrame, a table or view by name, or Parquet files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    session = spark or SparkSession.getActiveSession()
    return session.table(source)


def free_prefix(df: DataFrame) -> str:
    """A start of names that no column of ``df`` has."""
    prefix = "_t"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "t"
    return prefix


def files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back, so that every job sees the same rows."""
    path = shared_folder(df.sparkSession)
    df = df.withColumns({c: F.col("`" + c.replace("`", "``") + "`").cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_model(model: DataFrame, name: str) -> None:
    """A model is a table: (feature, coefficient), with a class for multinomial models."""
    model.write.mode("overwrite").saveAsTable(name)
