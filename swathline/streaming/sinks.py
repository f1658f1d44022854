"""A keyed table that micro-batches are merged into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class MergedTable:
    """Get-or-create by key for streams: every batch leaves its merged rows under its own number, and ``read`` merges them.

    ``merge`` makes rows of the same key one; it must give the same whatever the order and grouping.  A batch that is run again
    overwrites what it wrote the first time, so a replay changes nothing.  Every ``every`` batches the table so far is
    written as a new base, so a read merges one base and fewer than ``every`` batches.  A base is made from an older base
    and the batches after it, never in place: a run that is lost in the middle leaves the older base valid.  Older bases and
    batches stay until the folder's own retention removes them.  An empty table has no rows.  One stream writes to a folder.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, merge: Callable[[DataFrame], DataFrame], every: int = 16):
        self.spark, self.merge, self.every = spark, merge, every
        self.places = {kind: f"{folder}/{kind}" for kind in ("base", "batches")}
        self.schema = StructType([*schema.fields]).add("batch", "long")
        for place in self.places.values():
            spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("batch").parquet(place)

    def write(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        self._put(self.merge(rows), "batches", batch)
        if batch % self.every == self.every - 1:
            self._put(self._merged(batch, batch - 1), "base", batch)

    def read(self) -> DataFrame:
        newest = self._of("batches").agg(F.max("batch")).first()[0]
        return self._merged(-1 if newest is None else newest, -1 if newest is None else newest)

    def _merged(self, last: int, base_before: int) -> DataFrame:
        """Everything up to the batch ``last``, from the newest base up to ``base_before``."""
        bases = self._of("base").where(F.col("batch") <= base_before)
        base = bases.agg(F.max("batch")).first()[0]
        base = -1 if base is None else base
        later = self._of("batches").where((F.col("batch") > base) & (F.col("batch") <= last))
        first, newest = later.agg(F.min("batch"), F.max("batch")).first()
        if base < 0 and first == newest:  # a single batch is merged already
            return later.drop("batch")
        return self.merge(bases.where(F.col("batch") == base).unionByName(later).drop("batch"))

    def _of(self, kind: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.places[kind])

    def _put(self, rows: DataFrame, kind: str, batch: int) -> None:
        numbered = rows.withColumn("batch", F.lit(batch).cast("long"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.places[kind])
