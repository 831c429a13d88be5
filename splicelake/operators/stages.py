"""Counts of the stages of a pipeline, taken while its one job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageCounts:
    """Counts rows where they pass: no stage is run twice for its count.

    ``watch`` wraps a frame; once an action on a frame built from it has ended, ``rows`` gives one row per stage and measure (``n`` for all
    rows, and any named conditions, such as reasons of rejection).
    """

    def __init__(self) -> None:
        self._stages: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str, **conditions: Column) -> DataFrame:
        seen = Observation()
        self._stages.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])

    def rows(self, spark: SparkSession) -> DataFrame:
        found = [(i, stage, measure, n) for i, (stage, seen) in enumerate(self._stages) for measure, n in seen.get.items()]
        return spark.createDataFrame(found, "place int, stage string, measure string, n long")
