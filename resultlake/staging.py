"""Tables that end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder_of(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only where the session names no folder (tests on one machine) a local default is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir("/tmp/checkpoints")
        folder = str(context._jsc.sc().getCheckpointDir().get())
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below ``spark.checkpoint.dir`` and reads it: what has several readers runs once."""
    path = folder_of(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
