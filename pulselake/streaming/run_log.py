"""The log of runs as a stream whose aggregates grow with it.

Each batch of new files is reduced to its groups' moments, which are merged with those kept from
the batches before: no run is read twice, and what is kept is a row for each group.  Every so many
runs the aggregates are answered anew.

State and answers are written under the batch's number.  A batch that is repeated after a failure
starts from the state of the batch before it, and so replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.experiments import merged_moments, moments_report, run_moments
from .ingest import new_files

#: Aggregates are answered once so many runs have come since the last answer.
ANSWER_EVERY = 5


class RunLog:
    """Aggregates of a growing log, kept in ``folder``; ``split_key`` is the finer level's key."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], split_key: str, metrics: list[str], every: int = ANSWER_EVERY):
        self.spark, self.folder, self.keys, self.split_key, self.metrics, self.every = spark, folder, keys, split_key, metrics, every
        self._totals: dict[int, int] = {}

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/batch={number}"

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes one batch in."""
        levels = [*self.keys, self.split_key]
        parts, before = run_moments(batch, levels, self.metrics), 0
        if number > 0:
            kept = self.moments(number - 1)
            before = self._totals.get(number - 1) or self._total(number - 1)
            parts = merged_moments(parts.unionByName(kept), levels, self.metrics)
        parts.write.mode("overwrite").parquet(self._path("state", number))
        after = self._totals[number] = self._total(number)
        if after // self.every > before // self.every:
            for kind, table in (("by_split", self.by_split(number)), ("overall", self.overall(number))):
                table.withColumn("runs_seen", F.lit(after).cast("long")).write.mode("overwrite").parquet(self._path(kind, number))
        if number > 1:  # the state before this one is what a repeated batch starts from
            where, files = self._files(self._path("state", number - 2))
            files.delete(where, True)

    def take_new(self, path: str, schema: StructType, files_a_batch: int | None = None) -> None:
        """Takes in what files of ``path`` hold that were not seen before, and stops."""
        stream = new_files(self.spark, path, schema, files_a_batch).writeStream.foreachBatch(self.merge)
        stream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def moments(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self._path("state", number))

    def _total(self, number: int) -> int:
        return self.moments(number).agg(F.coalesce(F.sum("runs"), F.lit(0))).first()[0]

    def last(self) -> int | None:
        """The number of the last batch; None before the first."""
        where, files = self._files(f"{self.folder}/state")
        numbers = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(where)] if files.exists(where) else []
        return max(numbers, default=None)

    def by_split(self, number: int) -> DataFrame:
        return moments_report(self.moments(number), [*self.keys, self.split_key], self.metrics, "n_segseeds")

    def overall(self, number: int) -> DataFrame:
        return moments_report(merged_moments(self.moments(number).drop(self.split_key), self.keys, self.metrics), self.keys, self.metrics, "n_runs")

    def answers(self, kind: str) -> DataFrame:
        """All answers so far, ``by_split`` or ``overall``, with their ``batch`` and ``runs_seen``."""
        return self.spark.read.parquet(f"{self.folder}/{kind}")
