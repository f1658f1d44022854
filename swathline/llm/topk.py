"""Exact top-k search by inner product with a pivot table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PACKED = "block int, ids array<long>, vecs array<long>, away array<double>"


def whole_vectors(vec: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as long; null for a vector that is null, empty or has a null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.size(vec) > 0, F.when(~bad, F.transform(vec, lambda x: F.floor(x.cast("double") * scale))))


def top_descriptors(queries: DataFrame, descriptors: DataFrame, k: int = 20, pivots: int = 24,
                    query_block: int = 512, block: int = 4096, first: int = 64) -> DataFrame:
    """The ``k`` descriptors of highest inner product for each query: (query_id, rank, desc_id, score).

    ``queries`` and ``descriptors``: desc_id long, vec array<long> (see ``whole_vectors``), all of one length.
    A query's own desc_id is no candidate; equal scores go to the smaller desc_id; fewer than ``k`` candidates
    give fewer rows.  Rows with a null id or vec take no part; vectors of another length than the first pivot's
    raise an error.  Repeated rows are repeated candidates.

    Inner product becomes a distance by one more component, which makes all candidates equally long: the
    farther from the query, the smaller the product.  Distances from every candidate to the pivots (those with
    the lowest id hash) are kept with it.  By the triangle inequality the largest difference to the query's
    own pivot distances is a lower bound of the distance, hence an upper bound of the score.  Each task takes
    a block of queries and a block of candidates, orders every query's candidates by that bound, evaluates
    them exactly in growing rounds and stops when the next bound is below the k-th best score.  Winners of all
    blocks are merged.  A task holds two blocks of fixed size; queries and candidates are dealt by hash, so
    equal vectors spread.
    """
    base = descriptors.select("desc_id", "vec").where("desc_id IS NOT NULL AND vec IS NOT NULL")
    asked = queries.select("desc_id", "vec").where("desc_id IS NOT NULL AND vec IS NOT NULL")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = base.agg(F.count("*").alias("n"), F.max(norm).alias("far")).first()
    chosen = base.orderBy(F.xxhash64("desc_id"), "desc_id", "vec").limit(pivots).collect()
    if not chosen:
        return base.limit(0).select(F.col("desc_id").alias("query_id"), F.lit(0).alias("rank"), "desc_id", F.lit(0).cast("long").alias("score"))
    table = np.array([r.vec for r in chosen], np.float64)
    far = float(sizes.far)
    blocks, query_blocks = -(-sizes.n // block), -(-asked.count() // query_block)
    packed = _packed(base, blocks, table, far, True)
    wanted = _packed(asked, query_blocks, table, far, False).select(
        F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("away").alias("q_away"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = wanted.join(packed, "block").repartition(F.xxhash64("block", F.element_at("q_ids", 1)))
    scored = pairs.mapInPandas(lambda it: _search(it, k, first, table.shape[1], far), "query_id long, desc_id long, score long")
    best = scored.groupBy("query_id", F.pmod("desc_id", F.lit(64)).alias("_part")).agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "desc_id"))), 1, k).alias("best"))
    merged = best.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "b.desc_id", (-F.col("b.below")).alias("score"))


def _packed(rows: DataFrame, blocks: int, table: np.ndarray, far: float, long: bool) -> DataFrame:
    """One row per block, with the distances to the pivots; ``long``: with the component that makes all equally long."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        whole = np.stack(group["vec"].to_numpy()).astype(np.int64)
        vecs = whole.astype(np.float64)
        n2, p2 = (vecs ** 2).sum(1), (table ** 2).sum(1)
        extra = np.sqrt(np.maximum(far - n2, 0)) if long else np.zeros(len(vecs))
        d2 = n2[:, None] + extra[:, None] ** 2 + far - 2 * (vecs @ table.T + extra[:, None] * np.sqrt(np.maximum(far - p2, 0)))
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "ids": [group["desc_id"].to_numpy()],
                             "vecs": [whole.ravel()], "away": [np.sqrt(np.maximum(d2, 0)).ravel()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("desc_id", "vec", F.lit(7)), F.lit(max(blocks, 1))).cast("int"))
    return dealt.groupBy("block").applyInPandas(pack, PACKED)


def _search(batches: Iterator[pd.DataFrame], k: int, first: int, width: int, far: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            q, c = np.asarray(r.q_vecs).reshape(-1, width), np.asarray(r.vecs).reshape(-1, width)
            q_ids, ids = np.asarray(r.q_ids), np.asarray(r.ids)
            near = np.asarray(r.q_away, np.float32).reshape(len(q), -1), np.asarray(r.away, np.float32).reshape(len(c), -1)
            yield _block(q, q_ids, near[0], c, ids, near[1], k, first, far)


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T as whole numbers: in doubles where no partial sum can reach 2**53, else in 64-bit integers."""
    if np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0).astype(float) * q.shape[1] < 2 ** 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _block(q, q_ids, q_away, c, ids, away, k: int, first: int, far: float) -> pd.DataFrame:
    gap, step = np.zeros((len(q), len(c)), np.float32), np.empty((len(q), len(c)), np.float32)
    for p in range(away.shape[1]):
        np.subtract(q_away[:, p, None], away[None, :, p], out=step)
        np.maximum(gap, np.abs(step, out=step), out=gap)
    q2 = (q.astype(np.float64) ** 2).sum(1)
    # the slack covers the rounding of the distances to single precision
    slack = 1e-5 * float(max(q_away.max(initial=1), away.max(initial=1)))
    bound = (q2[:, None] + far - np.maximum(gap - slack, 0).astype(np.float64) ** 2) / 2 + 1
    bound[q_ids[:, None] == ids[None, :]] = -np.inf
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    floor, active, done, size = np.full(len(q), -np.inf), np.arange(len(q)), 0, first
    while len(active) and done < len(c):
        size = min(size, len(c) - done)
        rest = bound[active]
        taken = np.argpartition(-rest, size - 1, axis=1)[:, :size] if size < rest.shape[1] else np.broadcast_to(np.arange(len(c)), rest.shape)
        ceiling = np.take_along_axis(rest, taken, 1)
        if size * 4 >= len(c):
            score = np.take_along_axis(exact_products(q[active], c), taken, 1)
        else:
            score = np.stack([exact_products(q[a][None], c[t])[0] for a, t in zip(active, taken, strict=True)])
        for row, a in enumerate(active):
            good = ceiling[row] >= floor[a]
            good &= ceiling[row] > -np.inf
            s = np.concatenate([best[a][0], score[row][good]])
            i = np.concatenate([best[a][1], ids[taken[row]][good]])
            keep = np.lexsort((i, -s))[:k]
            best[a] = s[keep], i[keep]
            if len(keep) == k:
                floor[a] = s[keep[-1]]
            bound[a, taken[row]] = -np.inf
        done += size
        size *= 4
        active = active[bound[active].max(1) >= np.maximum(floor[active], -1e300)]
    return pd.DataFrame({"query_id": np.repeat(q_ids, [len(b[0]) for b in best]),
                         "desc_id": np.concatenate([b[1] for b in best]) if best else np.zeros(0, np.int64),
                         "score": np.concatenate([b[0] for b in best]) if best else np.zeros(0, np.int64)})
