"""Document fingerprints by order MinHash (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.llm.common import words_lower

#: Low bits of a packed number that hold a place in the text.
PLACE = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(value: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(value, PLACE), PLACE).bitwiseOR(place.cast("long"))


def place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")


def order_minhash(text: Column, k: int = 3, tuples: int = 32, length: int = 2) -> Column:
    """Array of ``tuples`` hashes (null where a part of the hash range got no k-mer); empty for a text without words.

    The k-mers are runs of ``k`` words, A-Z in lower case (all words, if fewer), each with the number of its
    occurrence: a repeated run is another k-mer each time.  Their hashes are dealt into ``tuples`` parts of the
    hash range.  Of each part the ``length`` smallest are taken, put back into the order of the text and hashed
    together, so a signature is kept only when the same k-mers stand in the same order.
    """

    def hashes(words: Column) -> Column:
        n = F.greatest(F.size(words) - (k - 1), F.lit(1))
        one = [F.get(words, F.lit(j)) for j in range(k)]
        runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
        return F.when(F.size(words) == 0, F.expr("cast(array() AS array<bigint>)")).when(
            F.size(words) < k, F.array(F.xxhash64(*one))).otherwise(runs)

    steps = F.lit([1 << b for b in range(PLACE - 1, -1, -1)])

    def numbered(ranked: Column) -> Column:
        """``ranked``: k-mer hash and place, ascending.  -> the hash of k-mer and occurrence, and the place, ascending."""
        def occurrence(x: Column, i: Column) -> Column:
            h = F.shiftright(x, PLACE)
            again = (i > 0) & (F.shiftright(F.get(ranked, i - 1), PLACE) == h)
            # the run of equal hashes begins at its lower bound, found by halving
            low = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(
                F.shiftright(F.get(ranked, lo + step - 1), PLACE) < h, lo + step).otherwise(lo))
            return packed(F.xxhash64(h, F.when(again, i - low).otherwise(F.lit(0))), place_of(x))
        return F.sort_array(F.transform(ranked, occurrence))

    bits = tuples.bit_length() - 1

    def part(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - bits).cast("int")

    def signature(kmers: Column, chosen: Column) -> Column:
        def one(p: Column) -> Column:
            own = F.sort_array(F.transform(F.filter(chosen, lambda x: part(x) == p), place_of))
            return let(own, lambda o: F.when(F.size(o) > 0, F.xxhash64(*[F.get(kmers, F.get(o, F.lit(j))) for j in range(length)])))
        return F.transform(F.sequence(F.lit(0), F.lit(tuples - 1)), one)

    def smallest(order: Column) -> Column:
        """The first ``length`` of each part of the range."""
        return F.filter(order, lambda x, i: (i < length) | (part(F.get(order, i - length)) != part(x)))

    return let(words_lower(text), lambda words: let(F.transform(words, lambda w: F.xxhash64(w)), lambda wh: let(hashes(wh), lambda kmers: let(
        F.sort_array(F.transform(kmers, lambda h, i: packed(h, i))), lambda ranked: let(numbered(ranked), lambda order: let(
            smallest(order), lambda chosen: F.when(F.size(kmers) == 0, F.expr("cast(array() AS array<bigint>)")).otherwise(
                signature(kmers, chosen))))))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the signatures that are equal, of those that either has (0 to 1); two empty fingerprints are alike (1)."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False)))), lambda m: m.isNotNull())
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        let(both, lambda m: F.size(F.filter(m, lambda x: x)) / F.size(m)))


def as_text(print_: Column) -> Column:
    """Sixteen hexadecimal digits for each signature, dashes for one that is missing."""
    return F.array_join(F.transform(print_, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("-" * 16))), "")


def edited_fingerprints(datasets: DataFrame, slices: int | None = None, **method: int) -> DataFrame:
    """``datasets`` (id long, notes) -> (id, n_chars, edited, print, edited_print, near_edited, near_next), a row for each row given.

    The next note is the one with the next smaller id; after the last comes the first.  ``edited`` is the note
    with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next note.
    ``near_*``: likeness of the note's fingerprint to that of ``edited``, and to the next note's.  Null notes
    count as empty; an empty note's fingerprint is empty.  Of equal ids the note with the lower hash comes
    later in the order; a null id comes last of all.  An only row is its own next.  Other columns are not looked at.

    Ids are cut into ``slices`` ranges of about equal numbers of rows (four for each shuffle partition, 256 at least;
    the bounds come from one approximate quantile).  The next note is found inside a range, and the highest row
    of each range is also sent to the range above as a guest, so one shuffle of the texts is enough.
    """
    slices = slices or max(256, 4 * int(datasets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("notes", F.lit(""))
    rows = datasets.select(F.col("id").cast("long").alias("id"), text.alias("notes"), order_minhash(text, **method).alias("print"))
    ids = datasets.select(F.col("id").cast("long").alias("id"), F.xxhash64(text).alias("_tie"))
    marks = ids.agg(F.percentile_approx("id", [i / slices for i in range(1, slices)], max(10_000, 10 * slices)).alias("b")).first()["b"]
    bounds = sorted(set(marks or []))
    # range 0 is the rows without an id; the others are found by halving
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)] or [1]
    edges = F.lit(bounds).cast("array<bigint>")
    below = F.aggregate(F.lit(steps), F.lit(0), lambda lo, step: F.when(F.get(edges, lo + step - 1) < F.col("id"), lo + step).otherwise(lo))
    slice_of = F.when(F.col("id").isNull(), 0).otherwise(below + 1)
    top = F.max(F.struct("id", "_tie"))
    highest = {r["s"]: r["t"] for r in ids.groupBy(slice_of.alias("s")).agg(top.alias("t")).collect()}
    known = sorted(highest)
    above = dict(zip(known, known[1:] + known[:1], strict=True))
    places = range(len(bounds) + 2)
    top_id = F.lit([(highest[s]["id"] if s in highest else 0) or 0 for s in places]).cast("array<bigint>")
    top_tie = F.lit([highest[s]["_tie"] if s in highest else 0 for s in places]).cast("array<bigint>")
    to = F.get(F.lit([above.get(s, 0) for s in places]), F.col("_slice"))
    tagged = rows.withColumns({"_slice": slice_of, "_tie": F.xxhash64("notes")})
    is_top = (F.col("_tie") == F.get(top_tie, F.col("_slice"))) & ((F.col("_slice") == 0) | (F.col("id") == F.get(top_id, F.col("_slice"))))
    own, guest = F.struct(F.col("_slice").alias("home"), F.lit(False).alias("guest")), F.struct(to.alias("home"), F.lit(True).alias("guest"))
    dealt = tagged.select("id", "notes", "print", "_tie", F.inline(F.when(is_top, F.array(own, guest)).otherwise(F.array(own))))
    order = W.partitionBy("home").orderBy("guest", F.col("id").desc_nulls_last(), F.col("_tie").desc())
    following = dealt.withColumns({"_text": F.lead("notes").over(order), "_print": F.lead("print").over(order)}).where("NOT guest")
    length = F.length("notes")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring("notes", F.lit(1), length - half), F.substring("_text", F.lit(1), half))
    whole = following.withColumns({"n_chars": length.cast("long"), "edited": edited}).withColumn("edited_print", order_minhash(F.col("edited"), **method))
    return whole.select("id", "n_chars", "edited", "print", "edited_print", likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                        likeness(F.col("print"), F.col("_print")).alias("near_next"))
