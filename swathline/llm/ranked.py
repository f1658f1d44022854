"""Ranked lexical search: an automaton of all search terms runs over the notes, its outputs lead to the searches."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term is a longest run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes: letters in lower case, all that ends a term is a blank, which guards the automaton's words on both sides.
GUARD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: A block of searches: its terms' bytes, which bound the automaton, the weights and the postings that go to the tasks.
BLOCK_BYTES = 8_000_000
#: Cells (notes times searches) of the score table that a task holds at once.
CELLS = 2_000_000
VECTOR = "id long, named boolean, n long, terms array<int>, tfs array<int>"


def search_terms(text: Column) -> Column:
    """Terms of a text, with repeats; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def search_blocks(searches: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, list[str]]]]:
    """Searches with their distinct terms, in blocks of at most ``most`` bytes of terms (a longer search is a block of its own).

    Rows come in the order of search_id, one partition at a time, so the driver never holds more than a block and a partition.
    """
    rows = searches.where("search_id IS NOT NULL").select("search_id", F.explode(search_terms(F.col("search"))).alias("term")).distinct().orderBy("search_id", "term")
    block: list[tuple[int, list[str]]] = []
    held = 0
    for search, term in rows.toLocalIterator():
        if not block or block[-1][0] != search:
            if held > most:
                yield block
                block, held = [], 0
            block.append((search, []))
        block[-1][1].append(term)
        held += len(term.encode("utf-8", "surrogatepass")) + 8
    if block:
        yield block


def term_vectors(datasets: DataFrame, terms: list[str]) -> DataFrame:
    """``datasets`` (id, notes) -> (id, named, n, terms, tfs) for notes with a term: n of them, and which of ``terms`` how often.

    ``named``: the row has an id.  The automaton holds every term between two blanks and runs once over the whole note, so
    notes need no index, and a term inside a longer one is never counted.
    """
    guarded = [b" %s " % t.encode("utf-8", "surrogatepass") for t in terms]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(guarded):
            automaton.add_word(word.decode("latin-1"), i)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for id_, named, text in batch.itertuples(index=False):
                raw = text.encode("utf-8", "surrogatepass").translate(GUARD)
                n = len(raw.split())
                if n:
                    tfs = Counter(map(itemgetter(1), automaton.iter(f" {raw.decode('latin-1')} "))) if guarded else {}
                    out.append((id_, named, n, np.fromiter(tfs, np.int32, len(tfs)), np.fromiter(tfs.values(), np.int32, len(tfs))))
            yield pd.DataFrame(out, columns=["id", "named", "n", "terms", "tfs"])

    rows = datasets.select(F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNotNull().alias("named"), F.coalesce("notes", F.lit("")).alias("notes"))
    return rows.mapInPandas(scan, VECTOR)


def term_weight(notes: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * notes + 2) / (2 * having + 1)))


def scores(batch: pd.DataFrame, weights: np.ndarray, starts: np.ndarray, owners: np.ndarray, searches: int, notes: int, length: int) -> np.ndarray:
    """Scores of a batch of ``term_vectors``: a row for each note, a column for each search, in 64-bit integers.

    ``owners[starts[t]:starts[t + 1]]`` are the searches that hold term t.
    """
    many = batch["terms"].map(len).to_numpy(np.int64)
    note = np.repeat(np.arange(len(batch)), many)
    term, tf = (np.concatenate([*batch[c], np.zeros(0, np.int32)]).astype(np.int64) for c in ("terms", "tfs"))
    m = 50 + 50 * batch["n"].to_numpy(np.int64) * notes // length
    part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[note]))
    copies = starts[term + 1] - starts[term]
    place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(starts[term], copies)
    out = np.zeros(len(batch) * searches, np.int64)
    np.add.at(out, np.repeat(note, copies) * searches + owners[place], np.repeat(part, copies))
    return out.reshape(len(batch), searches)


def best(search: np.ndarray, id_: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each search, equal ones by smaller id."""
    order = np.lexsort((id_, -score, search))
    first = np.searchsorted(search[order], search[order])
    return order[np.arange(len(order)) - first < k]


def rank_block(spark: SparkSession, datasets: DataFrame, block: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """(search_id, id, score) of the ``k`` best notes of every search of a block, and of each task's own ones before."""
    terms = sorted({t for _, own in block for t in own})
    number = {t: i for i, t in enumerate(terms)}
    pairs = sorted((number[t], j) for j, (_, own) in enumerate(block) for t in own)
    owners = np.array([j for _, j in pairs], np.int64)
    starts = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(terms) + 1))
    vectors = cut(term_vectors(datasets, terms))
    notes, length = vectors.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = np.zeros(len(terms), np.int64)
    for t, c in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        having[t] = c
    weights = np.array([term_weight(notes, int(c)) for c in having], np.int64)
    ids = np.array([s for s, _ in block], np.int64)
    shared = spark.sparkContext.broadcast((weights, starts, owners, ids))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, starts, owners, ids = shared.value
        step = max(16, CELLS // len(ids))
        top = [np.zeros(0, np.int64)] * 3
        floor = np.zeros(len(ids), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), step):
                rows = batch.iloc[lo:lo + step]
                found = scores(rows, weights, starts, owners, len(ids), notes, length)
                note, search = np.nonzero((found > 0) & (found >= floor))
                both = [np.concatenate(p) for p in zip(top, (search, rows["id"].to_numpy(np.int64)[note], found[note, search]), strict=True)]
                chosen = best(*both, k)
                top = [x[chosen] for x in both]
                full = np.bincount(top[0], minlength=len(ids)) >= k
                last = np.searchsorted(top[0], np.arange(len(ids)), "right") - 1
                floor = np.where(full, top[2][last] if len(top[2]) else 0, 0)
        yield pd.DataFrame({"search_id": ids[top[0]], "id": top[1], "score": top[2]})

    return vectors.where("named").select("id", "n", "terms", "tfs").mapInPandas(rank, "search_id long, id long, score long")


def ranked_datasets(datasets: DataFrame, searches: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` datasets whose notes fit each search best: ``datasets`` (id long, notes), ``searches`` (search_id long, search) ->
    (search_id, rank, id, score), ranks from 1, equal scores by smaller id, only scores above 0.

    All notes count for the frequency of terms and the mean length, and a search looks at all of them.  Searches go in
    blocks of ``BLOCK_BYTES`` bytes of terms, one scan of the notes for each block; terms' counts, weights and postings of a block are all
    that the driver holds.  Every task keeps its ``k`` best of each search, and these are ranked in 64 slices before the slices meet.

    Null notes have no term.  A row without id counts in the statistics and is never ranked; repeated rows are ranked each.  Searches
    that share an id are one search with the terms of all; one without id or without a term gives no rows.  Other columns are
    not looked at.  No notes or no searches: no rows.
    """
    spark = datasets.sparkSession
    found = spark.createDataFrame([], "search_id long, id long, score long")
    for block in search_blocks(searches):
        found = found.unionByName(rank_block(spark, datasets, block, k))
    order = [F.col("score").desc(), F.col("id")]
    sliced = W.partitionBy("search_id", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order)
    few = found.withColumn("_s", F.row_number().over(sliced)).where(F.col("_s") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("search_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("search_id", "rank", "id", "score")
