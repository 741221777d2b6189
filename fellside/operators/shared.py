"""Cutting the lineage of what rounds go on from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder, which all executors share, and read again. Unlike a checkpoint it's computed once, and what the
    optimizer has inferred about it isn't carried on from round to round."""
    spark = df.sparkSession
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder.get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
