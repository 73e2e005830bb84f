"""What each stage of a plan let through: counts that Spark observes while the plan runs.

``Log.watch`` adds a stage's counts to the plan itself; they come with the action that runs it, no
stage is counted by a job of its own.  A stage that lost rows, or kept none, is a degraded one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "nth int, stage string, n bigint, flagged bigint, lost bigint, degraded boolean"


class Log:
    def __init__(self):
        self._stages: list[tuple[str, Observation]] = []

    def watch(self, rows: DataFrame, stage: str, flagged: Column | None = None) -> DataFrame:
        """``rows``, counted where the plan passes here, and those for which ``flagged`` holds."""
        seen = Observation(f"{len(self._stages)}-{stage}-{id(self)}")
        self._stages.append((stage, seen))
        told = F.coalesce(flagged, F.lit(False)) if flagged is not None else F.lit(False)
        return rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(told).alias("flagged"))

    def table(self, spark: SparkSession, allowed: float = 0.0) -> DataFrame:
        """LOG of the stages in order, once an action has run the plan.

        ``lost``: rows that the stage before had and this one hasn't; ``degraded``: more than the share
        ``allowed`` of them is lost, or none is left.  A plan that runs again counts its first run.
        """
        rows, before = [], None
        for nth, (stage, seen) in enumerate(self._stages):
            n, flagged = seen.get["n"], seen.get["flagged"]
            lost = 0 if before is None else max(0, before - n)
            rows.append((nth, stage, n, flagged, lost, n == 0 or lost > allowed * (before or 0)))
            before = n
        return spark.createDataFrame(rows, LOG)
