"""Packing of tokenised notes into sequences: bin completion over the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.llm.common import cut

#: Bounds of a task's stores of words already encoded: so many, none longer than so many characters.
STORE, LONGEST = 300_000, 48
#: Letters of ASCII and Latin-1 between marks without an apostrophe: the tokenizer lower-cases them and takes the
#: marks before, the letters and the marks after as three words.
PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder(dict):
    """Token ids (little-endian unsigned 32-bit) of whole texts, a word at a time.

    The tokenizer's words never span a blank or a line feed, so a text's ids are those of what stands between them.
    Plain words go straight to the tokenizer's merging model, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, {}
        alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in alphabet]
        #: the byte-level alphabet: a printable character for each byte
        self.byte = {**{b: chr(b) for b in alphabet}, **{b: chr(256 + i) for i, b in enumerate(others)}}

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain and "<|" not in word:
            got = b"".join([self.merged(x.lower()) for x in plain.groups() if x])
        else:
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) > STORE:
                self.clear()
                self[""] = b""
            self[word] = got
        return got

    def merged(self, part: str) -> bytes:
        got = self.letters.get(part)
        if got is None:
            spelled = part if part.isascii() else "".join([self.byte[b] for b in part.encode()])
            got = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
            if len(part) <= LONGEST:
                if len(self.letters) > STORE:
                    self.letters.clear()
                self.letters[part] = got
        return got


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def pieces_udf(path: str, capacity: int, end_id: int):
    """Text -> its pieces of at most ``capacity`` tokens, the end token counted."""

    @F.pandas_udf(PIECES)
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in texts:
            out = []
            for text in batch:
                raw = own.ids(text) + tail
                out.append([{"piece": i, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                            for i, at in enumerate(range(0, len(raw), 4 * capacity))
                            for part in (raw[at:at + 4 * capacity],)])
            yield pd.Series(out)

    return pieces


def pack_notes(datasets: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, nodes: int = 2000) -> DataFrame:
    """``datasets`` (id, notes) -> (id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    A note is its token ids and then ``end_id``; a null or empty one is that token alone.  Only notes longer
    than ``capacity`` are cut, into full pieces and a last one.  Pieces share sequences of at most ``capacity``
    tokens, without gaps from 0.

    How many pieces there are of each length is at most ``capacity`` numbers, whatever the corpus.  ``plan``
    packs that histogram; each plan step is a filling and how often it is used.  The pieces of one length are
    numbered (by slices, so that a very common length is not one task's work) and take the places of their
    length in that order.  Repeated rows are packed as often as they stand there; an empty table gives no
    rows.  Other columns are not looked at.
    """
    cut_up = datasets.select("id", F.explode(pieces_udf(tokenizer, capacity, end_id)("notes")).alias("p")).select("id", "p.*")
    spread = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(1024))
    pieces = cut(cut_up.withColumn("_slice", spread))
    counts = cut(pieces.groupBy("length", "_slice").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(histogram, capacity, nodes)
    spark = datasets.sparkSession
    places = spark.createDataFrame(_places(steps), "length long, lo long, hi long, copies long, first long, at long")
    # every numbered slice of a length meets the plan steps that its numbers span
    order = W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    begun = counts.withColumn("_begun", F.coalesce(F.sum("n").over(order), F.lit(0)))
    slots = places.join(begun, "length").where("lo < _begun + n AND hi > _begun").groupBy("length", "_slice").agg(
        F.min("_begun").alias("_begun"), F.array_sort(F.collect_list(F.struct("lo", "hi", "copies", "first", "at"))).alias("_slots"))
    inner = F.row_number().over(W.partitionBy("length", "_slice").orderBy("id", "piece", "ids_crc32")) - 1
    numbered = pieces.withColumn("_inner", inner).join(slots, ["length", "_slice"]).withColumn("_number", F.col("_begun") + F.col("_inner"))
    slot = F.expr("filter(_slots, s -> s.lo <= _number AND s.hi > _number)[0]")
    placed = numbered.withColumn("_slot", slot).withColumn("_k", F.col("_number") - F.col("_slot.lo"))
    copies = F.col("_slot.copies")
    return placed.select("id", "piece", "start", "length", "ids_crc32",
                         (F.col("_slot.first") + F.floor(F.col("_k") / copies)).cast("long").alias("sequence_id"),
                         (F.col("_slot.at") + F.pmod("_k", copies) * F.col("length")).cast("long").alias("offset"))


def _places(steps: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Of each length in each step: the numbers it takes, copies in a filling, first sequence, offset in it."""
    used, first, out = Counter(), 0, []
    for filling, times in steps:
        at = 0
        for length, copies in sorted(filling.items(), reverse=True):
            lo = used[length]
            used[length] += copies * times
            out.append((length, lo, used[length], copies, first, at))
            at += copies * length
        first += times
    return out


def plan(histogram: dict[int, int], capacity: int, nodes: int = 2000) -> list[tuple[dict[int, int], int]]:
    """Fillings (length -> copies) and how often each is used, for all pieces of the histogram.

    Best-fit decreasing gives the incumbent.  Bin completion takes the longest piece left, looks for the
    undominated filling around it that wastes least, and uses that filling as often as the pieces allow, so
    every step uses up a length and there are as many steps as lengths at most.  It is given up when its
    waste so far already needs as many sequences as the incumbent, and the better of the two stays.
    """
    incumbent = best_fit(histogram, capacity)
    most = sum(t for _, t in incumbent)
    total = sum(length * n for length, n in histogram.items())
    if most == -(-total // capacity):
        return incumbent
    left, steps, spent, waste = dict(histogram), [], 0, 0
    while left:
        longest = max(left)
        filling = complete(left, longest, capacity, nodes)
        times = min(left[x] // c for x, c in filling.items())
        for x, c in filling.items():
            left[x] -= c * times
            if not left[x]:
                del left[x]
        steps.append((filling, times))
        spent += times
        waste += times * (capacity - sum(x * c for x, c in filling.items()))
        if -(-(total + waste) // capacity) >= most:
            return incumbent
    return steps if spent < most else incumbent


def complete(left: dict[int, int], longest: int, capacity: int, nodes: int) -> dict[int, int]:
    """The filling around one piece of the length ``longest`` that wastes least.

    Branches take lengths from long to short.  A branch ends where all that is left could not beat the
    incumbent (the first incumbent is the best fit: always the longest that fits).  Fillings to which another
    piece could be added are dominated, and never reported.  ``nodes`` bounds the branches looked at; the
    incumbent is then the answer.
    """
    lengths = sorted((x for x in left if x <= capacity - longest), reverse=True)
    room = capacity - longest
    have = dict(left)
    have[longest] -= 1
    best: dict[int, int] = {}
    space = room
    for x in lengths:
        n = min(have[x], space // x)
        if n:
            best[x] = n
            space -= n * x
    least, seen = space, 0
    reach = np.cumsum([x * have[x] for x in reversed(lengths)])[::-1].tolist() + [0]

    def branch(i: int, space: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal best, least, seen
        seen += 1
        while i < len(lengths) and (lengths[i] > space or not have[lengths[i]]):
            i += 1
        if i == len(lengths):
            if space < least:
                best, least = dict(chosen), space
            return
        if space - reach[i] >= least:
            return
        for n in range(min(have[lengths[i]], space // lengths[i]), -1, -1):
            if least == 0 or seen > nodes:
                return
            branch(i + 1, space - n * lengths[i], [*chosen, (lengths[i], n)] if n else chosen)

    import sys
    if least and lengths:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, len(lengths) + 1000))
        try:
            branch(0, room, [])
        finally:
            sys.setrecursionlimit(limit)
    filling = dict(best)
    filling[longest] = filling.get(longest, 0) + 1
    return filling


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over the histogram, equal bins together.

    Bins of equal content are one entry with a number; a length goes to the fullest bins it fits, as many
    copies into each as fit, until it is used up.
    """
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        for room in sorted(r for r in bins if r >= length):
            if not n:
                break
            entries = bins.pop(room)
            while entries and n:
                filling, times = entries.pop()
                copies = room // length
                whole = min(times, n // copies)
                if whole:
                    bins.setdefault(room - copies * length, []).append(({**filling, length: copies}, whole))
                    n -= whole * copies
                    times -= whole
                if times and n:
                    rest = min(n, copies)
                    bins.setdefault(room - rest * length, []).append(({**filling, length: rest}, 1))
                    n -= rest
                    times -= 1
                if times:
                    entries.append((filling, times))
            if entries:
                bins.setdefault(room, []).extend(entries)
        copies = capacity // length
        if n // copies:
            bins.setdefault(capacity - copies * length, []).append(({length: copies}, n // copies))
        if n % copies:
            bins.setdefault(capacity - n % copies * length, []).append(({length: n % copies}, 1))
    return [e for entries in bins.values() for e in entries]
