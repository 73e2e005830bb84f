"""Sessions: what Python workers need to find this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


#: Spark's own bound of an Arrow batch, and ours: texts may be long, and workers share an executor.
BATCH, DEFAULT_BYTES, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    Suffices where workers see the driver's checkout or have the package at the same place; a
    cluster otherwise gets it by ``--py-files`` or an installed wheel, which this doesn't disturb.
    Also bounds Arrow batches by ``BYTES``, unless the session has set a bound.
    """
    if spark.conf.get(BATCH, None) == DEFAULT_BYTES:
        spark.conf.set(BATCH, BYTES)
    home = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if home not in paths:
        env["PYTHONPATH"] = ":".join([home, *filter(None, paths)])
    return spark
