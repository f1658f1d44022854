"""Toxicity of notes by non-negative positive-unlabelled learning: classifiers trained in numpy from confirmed examples and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.session import cut

#: Bytes as features see them: letters in lower case, bytes beyond ASCII as they are, everything else a blank.
FOLD = np.array([b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], np.uint32)
#: Lengths of the byte grams, and the bits of their hash.
GRAMS, BITS = (3, 4, 5, 6), 20
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def hashed_grams(x: np.ndarray) -> Iterator[np.ndarray]:
    """For each length the hash of the gram that starts at every byte of ``x`` (folded)."""
    if len(x) >= GRAMS[0]:
        head = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        for n in GRAMS:
            if n > GRAMS[0]:
                if len(x) < n:
                    return
                head = head[:-1] * np.uint32(0x01000193) ^ x[n - 1:]
            yield (head * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)


def texts_in_chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Folded bytes of many texts, a blank around each, with the text's number for every byte.  A text longer than
    ``size`` goes on in the next chunk, which repeats the last bytes that a gram can span."""
    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b"  ", np.uint8)
        for at in range(0, len(raw), size):
            part = raw[at:at + size + GRAMS[-1] - 1]
            parts.append(part)
            owners.append((i, len(part)))
            held += len(part)
            if held >= size:
                yield FOLD[np.concatenate(parts)], np.repeat([o for o, _ in owners], [n for _, n in owners])
                parts, owners, held = [], [], 0
    if parts:
        yield FOLD[np.concatenate(parts)], np.repeat([o for o, _ in owners], [n for _, n in owners])


def present(texts: list[str], place: np.ndarray, features: int) -> np.ndarray:
    """Which of the chosen features each text has: sorted numbers text * features + feature.  ``place`` leads from a hash to its
    feature, or to -1; grams that span two texts of a chunk hold blanks of both and fall to neither."""
    seen = []
    for x, owner in texts_in_chunks(texts):
        own = []
        for n, h in zip(GRAMS, hashed_grams(x), strict=False):
            f = place[h]
            at = np.flatnonzero(f >= 0)
            at = at[owner[at] == owner[at + n - 1]]
            own.append(owner[at] * features + f[at])
        if own:
            seen.append(np.unique(np.concatenate(own)))
    return np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)


@dataclass
class ToxicityModel:
    """``hashes[j]`` is feature j's hash; a text's score is the logistic function of ``bias`` and the ``weights`` of its features, a mean over classifiers."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def places(self) -> np.ndarray:
        place = np.full(1 << BITS, -1, np.int32)
        place[self.hashes] = np.arange(len(self.hashes), dtype=np.int32)
        return place

    def scores(self, texts: list[str], place: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(texts))
        at = present(texts, place, len(self.hashes))
        text, feature = at // len(self.hashes), at % len(self.hashes)
        sums = [np.bincount(text, w[feature], len(texts)) + b for w, b in zip(self.weights, self.bias, strict=True)]
        return np.mean([1 / (1 + np.exp(-np.clip(s, -30, 30))) for s in sums], 0)


def risk(margin_p: np.ndarray, margin_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the logistic risk: of confirmed examples as positive, and of the negatives inside the unlabelled text, which is
    the unlabelled risk less the positives' share of it (the class prior's correction)."""
    positive = prior * np.logaddexp(0, -margin_p).mean()
    return positive, np.logaddexp(0, margin_u).mean() - prior * np.logaddexp(0, margin_p).mean()


def train_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 150, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear classifier by Adam on the non-negative PU risk over all rows of ``xp`` (confirmed) and ``xu`` (unlabelled): while the
    negative part is below zero, a step goes up that part alone, so that nothing is gained by memorising unlabelled positives."""
    xp, xu = xp.astype(np.float32), xu.astype(np.float32)
    theta, mean, square = (np.zeros(xp.shape[1] + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        mp, mu = xp @ theta[:-1] + theta[-1], xu @ theta[:-1] + theta[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(mp, -30, 30))), 1 / (1 + np.exp(-np.clip(mu, -30, 30)))
        negative_p, negative_u = -prior * sp / len(xp), su / len(xu)
        if risk(mp, mu, prior)[1] < 0:
            gp, gu = -negative_p, -negative_u
        else:
            gp, gu = prior * (sp - 1) / len(xp) + negative_p, negative_u
        slope = np.append(gp @ xp + gu @ xu + decay * theta[:-1], gp.sum() + gu.sum())
        mean += 0.1 * (slope - mean)
        square += 0.001 * (slope * slope - square)
        theta -= rate * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train_classifiers(xp: np.ndarray, xu: np.ndarray, prior: float, classifiers: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of classifiers that each learn from another random half of the rows."""
    rng = np.random.default_rng(seed)
    halves = [[x[rng.permutation(len(x))[:-(-len(x) // 2)]] for x in (xp, xu)] for _ in range(classifiers)]
    fits = [train_nnpu(p, u, prior) for p, u in halves]
    return np.array([w for w, _ in fits]), np.array([b for _, b in fits])


def bounded_examples(datasets: DataFrame, most: int) -> DataFrame:
    """``datasets`` (id, notes, toxic) -> (notes, confirmed): at most ``most`` rows that are confirmed (toxic = 1) and twice as many of all
    rows as unlabelled text, those with the lowest hash of the id.

    Only ids are ranked, inside 64 slices of the hash, so no class is one task's work; texts are fetched for the chosen ids alone.
    """
    ids = datasets.select("id", (F.col("toxic") == 1).alias("_c"))
    both = ids.where("_c").union(ids.select("id", F.lit(False))).select("id", "_c", F.xxhash64(F.col("id").cast("string"), F.when(F.col("_c"), 1).otherwise(2)).alias("_h")).distinct()
    ranked = both.withColumn("_r", F.row_number().over(W.partitionBy("_c", F.pmod("_h", F.lit(64))).orderBy("_h", "id")))
    chosen = ranked.where(F.col("_r") <= F.when(F.col("_c"), most // 64).otherwise(most // 32)).select("id", F.col("_c").alias("confirmed"))
    return datasets.select("id", F.coalesce("notes", F.lit("")).alias("notes")).join(F.broadcast(chosen), "id").select("notes", "confirmed")


def fit_toxicity(datasets: DataFrame, prior: float | None = None, most: int = 2048, features: int = 2048, classifiers: int = 3) -> ToxicityModel:
    """A model from ``datasets`` (id, notes, toxic): toxic = 1 confirms an example, all rows together are the unlabelled text.

    ``prior`` is the share of toxic notes among all; without it, the share of 1 among the rows labelled 1 or 0 is taken (0.1 where no
    row is labelled 0).  At most ``most`` confirmed and twice as many unlabelled notes are learned from.  Features are the ``features``
    grams whose presence tells confirmed from unlabelled notes best; the driver gets their hashes and a bit for
    each of them and note (3 * most * features bits), no text.  Without a confirmed example the model scores everything 0.
    """
    spark = datasets.sparkSession
    ones, zeros = datasets.agg(*[F.count(F.when(F.col("toxic") == v, 1)) for v in (1, 0)]).first()
    if not ones:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    prior = prior if prior is not None else ones / (ones + zeros) if zeros else 0.1
    examples = cut(bounded_examples(datasets, most).repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, confirmed in batch.itertuples(index=False):
                own = np.zeros(1 << BITS, bool)
                for x, _ in texts_in_chunks([text]):
                    for h in hashed_grams(x):
                        own[h] = True
                found[int(confirmed)] += own
        at = np.flatnonzero(found.any(0))
        yield pd.DataFrame({"h": at, "u": found[0, at], "p": found[1, at]})

    sizes = {r["confirmed"]: r["count"] for r in examples.groupBy("confirmed").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    held = examples.mapInPandas(count, "h long, u long, p long").groupBy("h").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    both, share_p, share_u = (F.col("u") + F.col("p")) / F.lit(n_p + n_u), F.col("p") / F.lit(n_p), F.col("u") / F.lit(n_u)
    contrast = F.abs(share_p - share_u) / F.sqrt(both * (1 - both) + 1 / F.lit(n_p + n_u))
    top = held.where("p + u >= 3").orderBy(contrast.desc(), "h").limit(features).select("h").collect()
    hashes = np.array(sorted(r.h for r in top), np.int64)
    if not len(hashes):
        return ToxicityModel(hashes, np.zeros((0, 0)), np.zeros(0))
    place = ToxicityModel(hashes, np.zeros((0, 0)), np.zeros(0)).places()

    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), len(hashes)), bool)
        out.reshape(-1)[present(list(texts), place, len(hashes))] = True
        return pd.Series([np.packbits(row).tobytes() for row in out])

    rows = sorted((r.confirmed, bytes(r.bits)) for r in examples.select("confirmed", bits("notes").alias("bits")).collect())
    table = np.unpackbits(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1), axis=1, count=len(hashes)).astype(bool)
    confirmed = np.array([r[0] for r in rows])
    return ToxicityModel(hashes, *train_classifiers(table[confirmed], table[~confirmed], prior, classifiers))


def notes_toxicity(datasets: DataFrame, model: ToxicityModel, least: float = 0.7) -> DataFrame:
    """``datasets`` (id, notes) -> (id, score, toxic), one row for each row given; toxic is 1 from a score of ``least``, else 0.

    Only ``notes`` is looked at, whole texts of any length, a chunk of ``CHUNK`` bytes at a time.  Null counts as empty, and an empty text
    has the score of a text without features.  Repeated rows come out as often as they go in; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = model.places()
        for batch in texts:
            texts_ = ["" if t is None else t for t in batch]
            yield pd.Series(np.concatenate([np.zeros(0), *[model.scores(texts_[i:i + 256], place) for i in range(0, len(texts_), 256)]]))

    return datasets.select("id", score("notes").alias("score")).withColumn("toxic", (F.col("score") >= least).cast("int"))
