"""Filter interaction audit: truth-table survival words, counted by carry-save positional popcounts."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.session import cut

#: Filters of dataset notes; the place of a letter is its bit.  A: few words, B: few distinct words, C: many capitals, D: marks, E: copy.
FILTERS = "ABCDE"
ALL = 1 << len(FILTERS)
#: The survival word of each set of failed filters: bit s is 1 if a note that fails them passes every filter of the subset s.
WORDS = np.array([sum(1 << s for s in range(ALL) if not s & fails) for fails in range(ALL)], np.uint32)
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
AUDIT = ("org_id string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
         "toxic_lost long, shapley long")


def own_failures(text: str) -> int:
    """The bits of the filters A to D that ``text`` fails.  Words stand between ASCII blanks, capitals are A-Z."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    few = 100 * len(set(words)) < 50 * len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return (len(words) < 200) + 2 * few + 4 * (100 * capitals > 3 * len(text)) + 8 * marked


def facts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        batch = ["" if t is None else t for t in batch]
        yield pd.DataFrame({"fails": [own_failures(t) for t in batch],
                            "digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in batch]})


def failed_filters(datasets: DataFrame) -> DataFrame:
    """``datasets`` (id, org_id, notes) -> (id, org_id, fails): the bits of the filters A to E that each row's notes fail.

    E: some row of the whole table with a smaller id has the same notes (null counts as empty).  A null id is larger than every other,
    rows that repeat an id are no copies of each other.  Texts are compared by SHA-256, so only digests are shuffled, and a row
    asks for its own (digest, id) among the first ids of all digests: a text that a third of all rows share is no hot key.
    """
    read = F.pandas_udf(facts, "fails int, digest binary")
    base = cut(datasets.select("id", F.coalesce(F.col("org_id").cast("string"), F.lit("")).alias("org_id"), read("notes").alias("_f"))
               .select("id", "org_id", "_f.fails", "_f.digest"))
    first = base.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True)).alias("o")
    joined = base.alias("f").join(first, (F.col("f.digest") == F.col("o.digest")) & F.col("f.id").eqNullSafe(F.col("o.id")), "left")
    return joined.select("f.id", "f.org_id", (F.col("fails") + F.when(F.col("first"), 0).otherwise(16)).alias("fails"))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set.

    Carry-save: three words become a sum word and a carry word of twice the weight, for all 32 places at once, until one word of every weight is left.
    """
    counts, places, weight = np.zeros(32, np.int64), np.arange(32, dtype=np.uint32), 1
    while len(words):
        carries = []
        while len(words) > 2:
            n = len(words) // 3
            a, b, c = words[:n], words[n:2 * n], words[2 * n:3 * n]
            odd = a ^ b
            carries.append(a & b | odd & c)
            words = np.concatenate([odd ^ c, words[3 * n:]])
        if len(words) == 2:
            carries.append(words[:1] & words[1:])
            words = words[:1] ^ words[1:]
        counts += weight * (words[0] >> places & 1).astype(np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def subset_survivors(failures: DataFrame, reviews: DataFrame, held: int = 10_000) -> DataFrame:
    """``failures`` (id, org_id, fails), ``reviews`` (id, good, toxic) -> (org_id, label, survivors).

    ``survivors[s]``: how many rows of the organisation with that label (all, good, toxic) pass every filter of the subset s.
    Tasks count their own rows and hand on whenever they hold ``held`` counts, so a large organisation is no hot key.  Several
    reviews of one id count as one that is good or toxic if any is.
    """
    flags = reviews.groupBy("id").agg(F.max((F.col("good") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failures.join(flags, "id", "left").select("org_id", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, str], np.ndarray] = defaultdict(lambda: np.zeros(ALL, np.int64))

        def out() -> pd.DataFrame:
            table = pd.DataFrame({"org_id": [k[0] for k in found], "label": [k[1] for k in found], "survivors": list(found.values())})
            found.clear()
            return table

        for batch in batches:
            word = WORDS[batch["fails"].to_numpy()]
            for org, at in batch.groupby("org_id").indices.items():
                for label in ("all", "good", "toxic"):
                    own = at if label == "all" else at[batch[label].to_numpy()[at] == 1]
                    found[org, label] += positional_popcount(word[own])
            if len(found) > held:
                yield out()
        if found:
            yield out()

    parts = rows.mapInPandas(count, "org_id string, label string, survivors array<long>")
    sums = [F.sum(F.col("survivors")[s]) for s in range(ALL)]
    return parts.groupBy("org_id", "label").agg(F.array(*sums).alias("survivors"))


def order_rows(org: str, every: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """The audit's rows of one organisation, from its subset survivors."""
    k = len(FILTERS)
    shapley = {}
    for b in range(k):
        without = [s for s in range(ALL) if not s >> b & 1]
        ways = [factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s in without]
        shapley[b] = sum(w * int(every[s] - every[s | 1 << b]) for s, w in zip(without, ways, strict=True))
    for order in permutations(range(k)):
        name, before = "".join(FILTERS[b] for b in order), 0
        for step, b in enumerate(order, 1):
            after, rest = before | 1 << b, ALL - 1 - (1 << b)
            kept, removed = int(every[after]), int(every[before] - every[after])
            yield (org, name, step, kept, removed, int(every[0] - every[1 << b]) - removed, int(every[rest] - every[ALL - 1]),
                   int(good[before] - good[after]), int(toxic[before] - toxic[after]), shapley[b])
            before = after


def filter_audit(datasets: DataFrame, reviews: DataFrame) -> DataFrame:
    """How the filters A to E act on dataset notes in every order: ``datasets`` (id, org_id, notes), ``reviews`` (id, good, toxic) ->
    one row per organisation, order of the five filters and step.

    kept: rows left after the step.  removed: rows the step's filter removes there.  redundant: rows that fail it and are gone already.
    unique_fails: rows that fail it alone.  good_lost, toxic_lost: removed rows that reviews call good or toxic.  shapley: what
    the filter removes, added up over all 120 orders.

    Null notes count as empty, a null org_id as the empty text.  Repeated rows count as often as they stand in the table, a null id has
    no review.  Other columns are not looked at.  An empty table gives no rows; texts of any length are counted whole.
    """
    survivors = subset_survivors(failed_filters(datasets), reviews)
    labels = [F.max(F.when(F.col("label") == name, F.col("survivors"))).alias(name) for name in ("all", "good", "toxic")]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in AUDIT.split(", ")]
        for batch in batches:
            for org, *counts in zip(batch["org_id"], batch["all"], batch["good"], batch["toxic"], strict=True):
                yield pd.DataFrame(list(order_rows(org, *counts)), columns=columns)

    return survivors.groupBy("org_id").agg(*labels).mapInPandas(expand, AUDIT)
