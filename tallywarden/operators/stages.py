"""Counts of the stages of a run, taken while the stages are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallywarden.sources.tables import store


class StageCounts:
    """The stage table of one run.

    ``counted`` puts a count on the way of a stage's rows; it is filled by whatever
    job writes them, so nothing is read a second time. A stage that is written again
    after a failure keeps the count of the first run that ended.
    """

    def __init__(self, run: str) -> None:
        self.run = run
        self._observed: list[tuple[str, Observation]] = []

    def counted(self, df: DataFrame, **stages: Column) -> DataFrame:
        """``df`` with an aggregate per stage, by default the number of rows."""
        for name, value in stages.items():
            seen = Observation()
            self._observed.append((name, seen))
            df = df.observe(seen, value.alias("n"))
        return df

    def table(self, spark: SparkSession) -> DataFrame:
        """``run``, ``place``, ``stage`` and ``n``; waits for the stages to be written."""
        rows = [(self.run, k, name, seen.get["n"]) for k, (name, seen) in enumerate(self._observed)]
        return spark.createDataFrame(rows, "run string, place int, stage string, n long")

    def save(self, spark: SparkSession, path: str) -> None:
        """Puts the run into the table of all runs; the same run is replaced."""
        store(self.table(spark).coalesce(1), path, partition_by=["run"], replace_partitions=True)


def rows() -> Column:
    return F.count(F.lit(1))
