"""Ordered numbering, neighbours and quantiles that never put one whole group into one task.

A plain window partitioned by a key sorts that key's rows in one task.  Here the key is split into
buckets that follow the order; the windows run inside a bucket, and only one summary row per
(key, bucket) takes part in the cross-bucket step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucketed_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                        bucket: Column, name: str = "ordinal") -> DataFrame:
    """1-based position within ``keys``; ``bucket`` must not decrease along ``order``."""
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(
        W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    numbered = tagged.withColumn("_inner", inner)
    return (numbered.join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_before") + F.col("_inner"))
            .drop("_bucket", "_before", "_inner"))


SLOTS = 65536
SUBSLOTS = 4096


def _scaled(v: Column) -> tuple[Column, Column]:
    """Exponent of |v| and |v| over that power of two, less one."""
    size = F.abs(v)
    e = F.greatest(F.lit(-1000.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    return e, size / F.pow(F.lit(2.0), e) - 1.0


def value_slot(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises: exponent and the leading 16 bits of the mantissa.

    It depends on the value alone, so it needs no pass for the extremes, and every task gives a value the
    same slot.
    """
    e, frac = _scaled(v)
    inner = (e + 1100) * SLOTS + F.floor(frac * SLOTS)
    slot = F.when(v == 0, 0.0).when(F.abs(v) == float("inf"), 3000.0 * SLOTS).otherwise(inner)
    return (F.signum(v) * slot).cast("long")


def _subslot(v: Column) -> Column:
    _, frac = _scaled(v)
    part = frac * SLOTS - F.floor(frac * SLOTS)
    rank = F.floor(part * SUBSLOTS)
    return F.coalesce(F.when(v < 0, -rank).otherwise(rank), F.lit(0)).cast("long")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    weight: str | None = None, fine: bool = False) -> DataFrame:
    """Linearly interpolated quantiles per group, exact, as one column per entry of ``probs``.

    Two passes over the input.  The first counts values per (group, slot) inside the map tasks and finds the
    slots that hold the wanted ranks.  The second keeps only the rows of those slots, merges equal values and
    ranks what is left, some 1/20000 of a group.  ``fine`` cuts a slot into 4096 parts before ranking, for
    groups so large that even a slot should not be sorted in one task.
    """
    n = F.col(weight) if weight else F.lit(1)
    named = list(keys) or ["_all"]
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v))
    if not keys:
        base = base.withColumn("_all", F.lit(0))
    rows = base.select(*named, v.alias("_v"), n.cast("long").alias("_n"), value_slot(v).alias("_slot"))

    hist = rows.groupBy(*named, "_slot").agg(F.sum("_n").alias("_m"))
    line = W.partitionBy(*named)
    hist = hist.withColumns({
        "_end": F.sum("_m").over(line.orderBy("_slot").rowsBetween(W.unboundedPreceding, W.currentRow)),
        "_total": F.sum("_m").over(line)})
    wanted = []
    for label, q in probs.items():
        at = F.lit(float(q)) * (F.col("_total") - 1)
        for side, edge in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wanted.append(F.struct(F.lit(label).alias("label"), F.lit(side).alias("side"),
                                   edge.cast("long").alias("rank"), (at - F.floor(at)).alias("frac")))
    held = F.filter(F.array(*wanted), lambda t: (t["rank"] >= F.col("_end") - F.col("_m")) & (t["rank"] < F.col("_end")))
    spots = (hist.withColumn("_want", held).where(F.size("_want") > 0)
             .select(*named, "_slot", (F.col("_end") - F.col("_m")).alias("_base"), "_want"))

    where = [*named, "_slot"]
    # a slot has one base and one list of wanted ranks, so any row of it carries them
    live = rows.join(spots, where).groupBy(*where, "_base", "_v").agg(
        F.sum("_n").alias("_n"), F.first("_want").alias("_want"))
    part = where
    if fine:
        live = live.withColumn("_sub", _subslot(F.col("_v")))
        part = [*where, "_sub"]
        subs = live.groupBy(*part).agg(F.sum("_n").alias("_m"))
        before = F.sum("_m").over(W.partitionBy(*where).orderBy("_sub").rowsBetween(W.unboundedPreceding, -1))
        live = live.join(subs.select(*part, F.coalesce(before, F.lit(0)).alias("_before")), part)
    else:
        live = live.withColumn("_before", F.lit(0))
    run = F.sum("_n").over(W.partitionBy(*part).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = live.withColumn("_run", run)
    end = F.col("_base") + F.col("_before") + F.col("_run")
    hit = (ranked.withColumn("_hi", end).withColumn("_lo", F.col("_hi") - F.col("_n"))
           .withColumn("_t", F.explode(F.filter("_want", lambda t: (t["rank"] >= F.col("_lo")) & (t["rank"] < F.col("_hi"))))))
    out = []
    for label in probs:
        mine = F.col("_t.label") == label
        lo = F.max(F.when(mine & (F.col("_t.side") == "lo"), F.col("_v")))
        hi = F.max(F.when(mine & (F.col("_t.side") == "hi"), F.col("_v")))
        frac = F.max(F.when(mine, F.col("_t.frac")))
        # equal ends first: an interpolation between infinities is not a number
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * frac).alias(label))
    result = hit.groupBy(*named).agg(*out)
    return result if keys else result.drop("_all")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key.  Spark limits each group inside the map tasks before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
