"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.session import cut, shared_folder

#: The six ASCII white-space characters that end a word.
SPACE = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_lower(text: Column) -> Column:
    """Words of a text with A-Z (only) in lower case; none for a null or blank text."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, SPACE), lambda w: w != "")


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of steps that are done be deleted now: Spark does so when the driver's JVM collects the
    garbage that refers to them, which on a quiet driver may be long after the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: a cut of the lineage that takes a fraction of a
    checkpoint's disk.  An application's steps share one folder, named after it, which can go when the application is done."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/steps-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node, component), component being the smallest node reachable.

    Large-star and small-star rounds by turns, until the edges no longer change.  Every round works with one
    minimum per node (combined before the shuffle) and a join, so no neighbour list is ever gathered; each
    round's edges go to the checkpoint folder, so a lost executor costs one round.  Nodes without an edge
    (or with an edge to themselves only) are not returned.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
              .where("x > y").distinct())
    seen = None
    while True:
        large = now.join(_lowest(now, "y"), "y", "left").select("x", F.coalesce("m", "y").alias("y")).distinct()
        low = _lowest(large, "x")
        inner = large.join(low, "x").where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = cut(inner.union(low.select("x", "m")).distinct())
        state = now.agg(F.count("x"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if state == seen:
            return now.select(F.col("x").alias("node"), F.col("y").alias("component")).union(
                now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
        seen = state


def _lowest(edges: DataFrame, name: str) -> DataFrame:
    """Each node's smallest smaller neighbour.  The sum with 0 gives the join an exchange of its own, which
    adaptive execution can split when one node has very many edges."""
    return edges.groupBy("x").agg(F.min("y").alias("m")).select((F.col("x") + F.lit(0)).alias(name), "m")


def dealt_by_range(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` in range partitions along ``order``, the partition's number in ``name``, held in the checkpoint
    folder so that every reader sees the same partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()))


def carried(rows: DataFrame, part: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the last non-null ``value`` at or before each row, over all partitions of ``dealt_by_range``.

    Inside a partition a running window keeps it; from one partition to the next only one row per
    partition is carried.
    """
    inside = F.last(value, ignorenulls=True).over(
        W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    swept = rows.withColumn("_in", inside)
    marks = rows.where(F.col(value).isNotNull())
    key = F.struct(*order)
    ends = marks.groupBy(part).agg(F.max_by(value, key).alias("_end"))
    parts = rows.select(part).distinct().join(ends, part, "left")
    before = F.last("_end", ignorenulls=True).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select(part, before.alias("_start"))
    return swept.join(F.broadcast(starts), part, "left").withColumn(name, F.coalesce("_in", "_start")).drop("_in", "_start")
