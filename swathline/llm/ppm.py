"""Language-model scores by prediction by partial matching over the bytes of words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.llm.common import cut, stored

#: Bytes that no UTF-8 text has: before a word, and after it.
START, END = "\xfe", "\xff"
#: What can follow a context: every byte but START.
SYMBOLS = 255


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def table(texts: Iterable[str], numbers: Iterable[int], text: str, number: str) -> pd.DataFrame:
    return pd.DataFrame({text: np.array([*texts], object), number: np.array([*numbers], np.int64)})


def token_counts(datasets: DataFrame, held: int = 200_000) -> DataFrame:
    """``datasets`` (notes, trained) -> (word, known): every word of all notes and its number in the trained ones.

    A word is held as text of one character a byte (Latin-1); the empty word is the end of a note.  A task adds up
    as it reads and hands on whenever it holds ``held`` words.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()

        def rows() -> pd.DataFrame:
            out = table([w.decode("latin-1") for w in found], found.values(), "word", "known")
            found.clear()
            return out

        for batch in batches:
            for text, trained in zip(batch["notes"], batch["trained"], strict=True):
                words = words_of(text)
                words.append(b"")
                if trained:
                    found.update(words)
                else:
                    for w in set(words):
                        found.setdefault(w, 0)
                if len(found) > held:
                    yield rows()
        if found:
            yield rows()

    return datasets.select("notes", F.coalesce("trained", F.lit(False)).alias("trained")).mapInPandas(
        count, "word string, known long").groupBy("word").agg(F.sum("known").alias("known"))


def longest_contexts(words: DataFrame, order: int, held: int = 200_000) -> DataFrame:
    """``words`` (word, known) -> (gram, n): each byte of a word with up to ``order`` bytes before it, back to the word's start."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for word, known in zip(batch["word"], batch["known"], strict=True):
                s = START + word + END
                for i in range(1, len(s)):
                    found[s[max(0, i - order):i + 1]] += known
                    if len(found) > held:
                        yield table(found, found.values(), "gram", "n")
                        found.clear()
        if found:
            yield table(found, found.values(), "gram", "n")

    return words.mapInPandas(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_scores(grams: DataFrame) -> DataFrame:
    """``grams`` (gram, n) -> (gram, score): natural logarithm of the last byte's probability after the others (``code_scores``)."""
    pack = F.conv(F.concat(F.lit("1"), F.hex(F.encode("gram", "iso-8859-1"))), 16, 10).cast("long")
    coded = cut(grams.select("gram", pack.alias("code"), "n"))
    longest = coded.agg(F.coalesce(F.max(F.length("gram")), F.lit(1))).first()[0]
    return code_scores(coded.select("code", "n"), longest - 1).join(coded, "code").select("gram", "score")


def code_scores(grams: DataFrame, order: int) -> DataFrame:
    """``grams`` (code, n) -> (code, known, score): natural logarithm of the last byte's probability after the others.

    From the longest context that was seen, a symbol found there has its count's share of all counts plus one for each
    distinct symbol; what those ones leave is the escape (method C).  After an escape, the symbols of the longer
    context are excluded from the counts of the shorter one.  Below order 0 all symbols not yet seen share alike.

    A gram that was seen is found at its first level: it needs the sums of its own context, a window of 255 rows at most.
    Only grams that were never seen go down the levels, one level at a time.
    """
    whole = W.partitionBy(F.shiftright("code", 8))
    seen = grams.where("n > 0").select("code", F.col("n").alias("known"), F.log(F.col("n") / (F.sum("n").over(whole) + F.count("*").over(whole))).alias("score"))
    return seen.unionByName(unseen_scores(grams, order).withColumn("known", F.lit(0).cast("long")))


def of_length(column: str, k: int) -> Column:
    return F.col(column).between(1 << 8 * k, (2 << 8 * k) - 1)


def tail(column: str, k: int) -> Column:
    """A gram of ``k`` bytes without its first."""
    return F.col(column).bitwiseAND((1 << 8 * (k - 1)) - 1).bitwiseOR(F.lit(1 << 8 * (k - 1)))


def unseen_scores(grams: DataFrame, order: int) -> DataFrame:
    """(code, score) of the ``grams`` (code, n) with n = 0.

    The trie's nodes of k bytes are those of k + 1 bytes without their first, and the grams of k bytes.  A level looks only at
    the nodes of contexts that are asked for.  Nodes of one and two bytes and contexts of up to two bytes number 65,536 at most and go to
    all tasks, so the few contexts that everything ends in are no hot keys.
    """
    trie = {order + 1: grams.where((F.col("n") > 0) & of_length("code", order + 1))}
    for k in range(order, 0, -1):
        longer = trie[k + 1].select(tail("code", k + 1).alias("code"), "n")
        trie[k] = stored(longer.union(grams.where((F.col("n") > 0) & of_length("code", k)).select("code", "n")).groupBy("code").agg(F.sum("n").alias("n")))
    spark, done, pending = grams.sparkSession, [], None
    for k in range(order + 1, 0, -1):
        new = grams.where((F.col("n") == 0) & of_length("code", k)).select(
            "code", F.col("code").alias("node"), F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("long").alias("gone"))
        pending = (new if pending is None else new.union(pending)).withColumn("context", F.shiftright("node", 8))
        nodes = trie[k].select(F.shiftright("code", 8).alias("context"), F.col("code").alias("node"), "n")
        asked = nodes if k <= 2 else nodes.join(pending.select("context").distinct(), "context", "left_semi")
        if k > 1:
            below = trie[k - 1].select(F.col("code").alias("parent"), F.col("n").alias("m"))
            asked = asked.withColumn("parent", tail("node", k)).join(F.broadcast(below) if k <= 3 else below, "parent")
        else:
            asked = asked.withColumn("m", F.lit(0).cast("long"))
        sums = asked.groupBy("context").agg(F.sum("n").alias("all"), F.count("*").alias("d"), F.sum("m").alias("next_e"))
        own = nodes.select("node", "n")
        met = pending.join(F.broadcast(sums) if k <= 3 else sums, "context", "left").join(F.broadcast(own) if k <= 2 else own, "node", "left")
        total, kinds = F.col("all") - F.coalesce("e", F.lit(0)), F.col("d") - F.coalesce("gone", F.lit(0))
        share = F.when(F.col("n").isNotNull(), F.log(F.col("n") / (total + kinds))).when(kinds > 0, F.log(kinds / (total + kinds))).otherwise(0.0)
        now = cut(met.select("code", "node", (F.col("s") + share).alias("s"), F.col("n").isNotNull().alias("found"), F.col("next_e").alias("e"), F.col("d").alias("gone")))
        done.append(now.where("found").select("code", F.col("s").alias("score")))
        pending = now.where("NOT found").select("code", tail("node", k).alias("node") if k > 1 else "node", "s", "e", "gone")
    last = pending.select("code", (F.col("s") - F.log(F.lit(float(SYMBOLS)) - F.coalesce("gone", F.lit(0)))).alias("score"))
    for part in done:
        last = last.union(part)
    return last


def packed_gram(gram: str) -> int:
    """A gram of up to seven bytes as one number: a one, then its bytes."""
    return int.from_bytes(b"\1" + gram.encode("latin-1"), "big")


def word_scores(words: DataFrame, scores: DataFrame, order: int, shard: int = 1_000_000) -> DataFrame:
    """``words`` (word, known) -> the same with ``score``, the sum over the word's bytes.

    The grams' scores are sent to the tasks ``shard`` at a time, so memory doesn't grow with the trie; each shard
    gives partial sums.
    """
    pack = F.conv(F.concat(F.lit("1"), F.hex(F.encode("gram", "iso-8859-1"))), 16, 10).cast("long")
    keyed = cut(scores.select(F.expr("length(gram)").alias("size"), pack.alias("key"), "score"))
    shards = max(1, -(-keyed.count() // shard))
    spark = words.sparkSession
    parts = None
    for i in range(shards):
        own = keyed.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == i).select("key", "score").toArrow()
        keys = own["key"].to_numpy().astype(np.int64)
        rank = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[rank], own["score"].to_numpy()[rank]))
        part = words.mapInPandas(_summed(table, order), "word string, known long, score double")
        parts = part if parts is None else parts.unionByName(part)
    return parts if shards == 1 else parts.groupBy("word", "known").agg(F.sum("score").alias("score"))


def _summed(table, order: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values = table.value
        for batch in batches:
            if not len(batch):
                continue
            raw = [(START + w + END).encode("latin-1") for w in batch["word"]]
            flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
            sizes = np.array([len(r) for r in raw], np.int64)
            begins = np.cumsum(sizes) - sizes
            place = np.arange(len(flat)) - np.repeat(begins, sizes)
            code, bits = flat.copy(), np.full(len(flat), 8, np.int64)
            for back in range(1, order + 1):
                ok = place >= back
                code[ok] |= flat[np.nonzero(ok)[0] - back] << (8 * back)
                bits[ok] += 8
            code |= np.int64(1) << bits
            at = np.minimum(np.searchsorted(keys, code), max(len(keys) - 1, 0))
            hit = (keys[at] == code) & (place > 0) if len(keys) else np.zeros(len(flat), bool)
            gained = np.where(hit, values[at], 0.0) if len(keys) else np.zeros(len(flat))
            sums = np.add.reduceat(gained, begins)
            yield pd.DataFrame({"word": batch["word"], "known": batch["known"], "score": sums})

    return score


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """The words at or above the lowest count (in quarter steps of a power of two) that leaves ``most`` of them or fewer.

    Only the number of words in each step comes to the driver, a few hundred numbers at most.
    """
    step = F.floor(4 * F.log2(F.col("known") + 1))
    sizes = {r["step"]: r["count"] for r in words.where("known > 0").groupBy(step.alias("step")).count().collect()}
    lowest, total = None, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        lowest = at
    return words.where(F.lit(False)) if lowest is None else words.where(F.col("known") > 0).where(step >= lowest)


def streams(text: str | None, across: bool) -> list[bytes]:
    """The symbols of a note: every word with its end, and the empty word.  ``across``: one stream for the note, else one for each word."""
    words = [*words_of(text), b""]
    start, end = START.encode("latin-1"), END.encode("latin-1")
    return [start + end.join(words) + end] if across else [start + w + end for w in words]


def gram_codes(raws: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of ``raws`` with up to ``order`` before it as a number (``packed_gram``), and which of ``raws`` it stands in."""
    flat = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
    sizes = np.array([len(r) for r in raws], np.int64)
    owner = np.repeat(np.arange(len(raws)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code, bits = flat.copy(), np.full(len(flat), 8, np.int64)
    for back in range(1, order + 1):
        at = np.nonzero(place >= back)[0]
        code[at] |= flat[at - back] << (8 * back)
        bits[at] += 8
    code |= np.int64(1) << bits
    return code[place > 0], owner[place > 0]


def gram_counts(datasets: DataFrame, order: int, across: bool, held: int = 1_000_000) -> DataFrame:
    """``datasets`` (notes, trained) -> (code, n): every gram of all notes (``packed_gram``) and its number in the trained ones.

    A task adds up as it reads and hands on whenever it holds ``held`` grams.
    """

    def merged(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(codes, return_inverse=True)
        return keys, np.bincount(at, times, len(keys)).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo:lo + 200]
                own = [streams(t, across) for t in part["notes"]]
                learn = np.repeat([1 if t else 0 for t in part["trained"]], [len(x) for x in own])
                codes, owner = gram_codes([r for x in own for r in x], order)
                parts.append(merged(codes, learn[owner]))
                waiting += len(parts[-1][0])
                if waiting > held:  # parts are merged when so many grams wait, not after each
                    keys, sums = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    if len(keys) > held // 2:
                        yield pd.DataFrame({"code": keys, "n": sums})
                        keys = sums = np.zeros(0, np.int64)
                    parts, waiting = [(keys, sums)], 0
        keys, sums = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pd.DataFrame({"code": keys, "n": sums})

    return datasets.select("notes", "trained").mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def spelling_scores(rows: DataFrame, grams: DataFrame, order: int, across: bool, head: int) -> DataFrame:
    """``rows`` (id, tie, notes) and ``grams`` (code, n) -> (id, tie, score), in parts to be added up for each (id, tie).

    The most frequent grams (``head`` at most, however large the corpus) go to the tasks; a note's others are counted and meet their scores in a join.
    """
    scored = stored(code_scores(grams, order))
    common = frequent_words(scored, head).select("code", "score").toArrow()  # ``head`` pairs of numbers at most
    keys = common["code"].to_numpy().astype(np.int64)
    rank = np.argsort(keys)
    near = rows.sparkSession.sparkContext.broadcast((keys[rank], common["score"].to_numpy()[rank]))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values = near.value
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo:lo + 200].reset_index(drop=True)
                own = [streams(t, across) for t in part["notes"]]
                codes, owner = gram_codes([r for x in own for r in x], order)
                note = np.repeat(np.arange(len(own)), [len(x) for x in own])[owner]
                at = np.minimum(np.searchsorted(keys, codes), max(len(keys) - 1, 0))
                hit = keys[at] == codes if len(keys) else np.zeros(len(codes), bool)
                sums = np.bincount(note[hit], values[at[hit]], len(own)) if hit.any() else np.zeros(len(own))
                far = np.stack([note[~hit], codes[~hit]])
                (notes, rest), times = np.unique(far, axis=1, return_counts=True) if far.size else (far, np.zeros(0, np.int64))
                rows_of = np.concatenate([np.arange(len(own)), notes])
                # no gram has a code below 256: a note's own row meets nothing in the join, and spreads over its partitions
                yield pd.DataFrame({
                    "id": part["id"].iloc[rows_of].array, "tie": part["tie"].to_numpy()[rows_of],
                    "code": np.concatenate([-1 - np.abs(part["tie"].to_numpy() // 2), rest]),
                    "times": np.concatenate([np.zeros(len(own), np.int64), times]), "score": np.concatenate([sums, np.zeros(len(rest))])})

    kind = rows.schema["id"].dataType.simpleString()
    parts = rows.mapInPandas(split, f"id {kind}, tie long, code long, times long, score double")
    own = scored.select("code", F.col("score").alias("of_gram"))
    return parts.join(own, "code", "left").select("id", "tie", F.when(F.col("times") == 0, F.col("score")).otherwise(F.col("times") * F.col("of_gram")).alias("score"))


def score_notes(datasets: DataFrame, order: int = 5, head: int = 250_000, across: bool = False, head_grams: int = 500_000) -> DataFrame:
    """``datasets`` (id, notes, trained) -> (id, n_tokens, n_known, train_tokens, base_score, score), one row for each row given.

    Learns from the rows with ``trained`` true and scores all.  Tokens are words (A-Z in lower case) and one end.
    ``base_score``: unigram log10 probability with 0.1 added to every count.  ``score``: log10 probability of the note's
    tokens under the byte-context trie (``order`` bytes at most; every word ends with an end-of-word symbol, and the end of the
    note is the empty word).  Contexts run over the ends of words into the words before with ``across``, else back to the
    start of the word only.  ``n_known``: tokens with a count.

    The most frequent words and grams (``head`` and ``head_grams`` at most) go to the tasks; the others are counted for each note and meet theirs in a join.  Null notes are empty: one token.
    Untrained corpora give every symbol the same share.  Repeated rows come out as often as they go in; an
    empty table gives no rows.  Other columns are not looked at.  ``order`` is 6 at most.
    """
    if not 0 <= order <= 6:
        raise ValueError("order must be 0 to 6: a gram is packed into 64 bits")
    words = stored(token_counts(datasets))
    totals = words.agg(F.sum("known").alias("n"), F.count_if(F.col("known") > 0).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    grams = stored(gram_counts(datasets, order, across))
    floor = 0.1 * (v + 1) + n
    common = frequent_words(words, head).collect()
    known = {r["word"].encode("latin-1"): math.log10((r["known"] + 0.1) / floor) for r in common}
    near_words = datasets.sparkSession.sparkContext.broadcast(known)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = near_words.value
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo:lo + 500]
                out: dict[str, list] = {c: [] for c in ("at", "word", "times", "base", "hits")}
                for at, (tie, text) in enumerate(zip(part["tie"], part["notes"], strict=True)):
                    base = 0.0
                    hits, tokens = 0, words_of(text)
                    tokens.append(b"")
                    far: list[tuple[str, int]] = []
                    for w, times in Counter(tokens).items():
                        b = near.get(w)
                        if b is None:
                            far.append((w.decode("latin-1"), times))
                        else:
                            base += times * b
                            hits += times
                    # no word begins with END: such a row meets nothing in the join, and spreads over its partitions
                    far.append((END + str(tie), len(tokens)))
                    out["at"] += [at] * len(far)
                    out["word"] += [w for w, _ in far]
                    out["times"] += [n for _, n in far]
                    out["base"] += [0.0] * (len(far) - 1) + [base]
                    out["hits"] += [0] * (len(far) - 1) + [hits]
                at = np.array(out.pop("at"), np.int64)
                yield pd.DataFrame({"id": part["id"].iloc[at].array, "tie": part["tie"].to_numpy()[at], **out})

    kind = datasets.schema["id"].dataType.simpleString()
    tied = datasets.select("id", F.xxhash64(F.coalesce("notes", F.lit(""))).alias("tie"), "notes")
    rows = tied.mapInPandas(split, f"id {kind}, tie long, word string, times long, base double, hits long")
    own = words.select("word", F.col("known").alias("c"))
    whole, times = F.col("c").isNull(), F.col("times")
    met = rows.join(own, "word", "left").select(
        "id", "tie", whole.cast("long").alias("whole"), F.when(whole, times).otherwise(0).alias("tokens"),
        F.when(whole, F.col("base")).otherwise(times * F.log10((F.col("c") + 0.1) / F.lit(floor))).alias("base"),
        F.lit(0.0).alias("score"),
        F.when(whole, F.col("hits")).when(F.col("c") > 0, times).otherwise(0).alias("hits"))
    none = F.lit(0).cast("long")
    spelled = spelling_scores(tied, grams, order, across, head_grams).select(
        "id", "tie", none.alias("whole"), none.alias("tokens"), F.lit(0.0).alias("base"), "score", none.alias("hits"))
    sums = met.union(spelled).groupBy("id", "tie").agg(*[F.sum(c).alias(c) for c in ("whole", "tokens", "base", "score", "hits")])
    # rows with the same id and notes were added together: each gets its share
    each = sums.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))))
    return each.select("id", F.expr("tokens div whole").alias("n_tokens"), F.expr("hits div whole").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       (F.col("base") / F.col("whole")).alias("base_score"), (F.col("score") / F.col("whole") / math.log(10)).alias("score"))
