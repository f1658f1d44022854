"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.llm.common import connected_components, cut, fresh, release

#: BITS[b, j]: bit j of the byte b.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingles(text: str | None, n: int) -> list[bytes]:
    """Runs of ``n`` words, joined by a space, A-Z in lower case; fewer words: all of them; none: no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[n - 1:].tolist(), strict=False)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Rows of hash bytes -> the bytes whose bits are set in over half of the rows."""
    rows, width = hashes.shape
    counts = np.bincount((hashes + np.arange(width, dtype=np.int32) * 256).ravel(), minlength=256 * width)
    ones = counts.reshape(width, 256) @ BITS
    return np.packbits(ones * 2 > rows, axis=1, bitorder="little").ravel()


def fingerprint_udf(words: int = 3):
    """Text -> 64-bit SimHash of its word shingles under XXH64 with seed 42, repeats included, as a long."""

    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        digest = xxhash.xxh64_intdigest
        for batch in texts:
            out = np.zeros(len(batch), "<u8")
            for i, text in enumerate(batch):
                found = shingles(text, words)
                if found:
                    hashes = np.array([digest(s, 42) for s in found], "<u8")
                    out[i] = majority(hashes.view(np.uint8).reshape(-1, 8)).view("<u8")[0]
            yield pd.Series(out.view("<i8"))

    return fingerprint


def ball(value: Column, bits: int) -> Column:
    """``value`` itself and all values that differ from it in one of the low ``bits`` bits."""
    return F.transform(F.array(F.lit(0), *[F.lit(_signed(1 << j)) for j in range(bits)]), lambda f: value.bitwiseXOR(f))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_duplicate_notes(datasets: DataFrame, words: int = 3) -> DataFrame:
    """``datasets`` (id long, notes) -> (id, fingerprint, component_id), one row for each row given.

    Fingerprints link at 2 or fewer differing bits.  Each distinct fingerprint is dealt to itself and to its
    64 neighbours at half the radius; two fingerprints link exactly when they meet somewhere, and all that
    meet at one place are within 2 bits of each other, so a chain through each meeting place (65 at most)
    loses nothing.  Links found more than once are made one, and every link's distance is checked.  Equal
    fingerprints are one node from the start, however many rows have them.

    ``fingerprint`` has 16 hexadecimal digits, ``component_id`` is the smallest id reachable.  Null and blank notes have fingerprint
    zero and link like any other.  Repeated rows come out as often as they go in; rows with a null id get the component of
    their fingerprint (null if it has only such rows).  An empty table gives no rows.  Other columns are not looked at.
    """
    prints = cut(datasets.select("id", fingerprint_udf(words)("notes").alias("print")))
    nodes = prints.groupBy("print").agg(F.min("id").alias("first"))
    met = nodes.where("first IS NOT NULL").select("print", F.explode(ball(F.col("print"), 64)).alias("place"))
    before = F.lag("print").over(W.partitionBy("place").orderBy("print"))
    links = met.withColumn("other", before).where("other IS NOT NULL").select("print", "other").distinct()
    links = links.where(hamming(F.col("print"), F.col("other")) <= 2)
    named = nodes.select(F.col("print").alias("other"), F.col("first").alias("b"))
    edges = links.join(nodes.withColumnRenamed("first", "a"), "print").join(named, "other").select("a", "b")
    groups = connected_components(edges)
    classes = nodes.join(groups.select(F.col("node").alias("first"), "component"), "first", "left").select(
        F.col("print").bitwiseXOR(F.lit(0)).alias("print"), F.coalesce("component", "first").alias("component_id"))
    return prints.join(classes, "print", "left").select(
        "id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --- similar notes: several bands, checked by the shingles themselves ---------------------------------------------


@dataclass(frozen=True)
class Bands:
    """How SimHashes are cut into bands: ``count`` bands of ``bits`` bits, each with its ball of radius 1.

    ``apart``: the share of bits in which notes of the wanted similarity differ.
    """

    count: int
    bits: int
    apart: float

    def far(self, bits: int) -> int:
        """The distance over ``bits`` bits that notes of the wanted similarity pass once in ten thousand times or less."""
        return math.ceil(bits * self.apart + 4 * math.sqrt(bits * self.apart * (1 - self.apart)))


def plan_bands(notes: int, similarity: float, recall: float = 0.95) -> Bands:
    """Bands for so many different notes.

    Shingle sets of Jaccard similarity s have the cosine 2s / (1 + s), and so differ in acos(cosine) / pi of
    their SimHash bits.  A band is as wide as keeps its places sparse (64 for each note at least, never under 24 bits), and there are as
    many bands as let two notes of that similarity meet in some band with a probability of ``recall`` or more.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(24, math.ceil(math.log2(max(notes, 1))) + 6)
    near = sum(math.comb(bits, d) * apart ** d * (1 - apart) ** (bits - d) for d in range(3))
    return Bands(math.ceil(math.log(1 - recall) / math.log(1 - near)) if near < 1 else 1, bits, apart)


def parities(places: np.ndarray) -> np.ndarray:
    """Bytes -> 256 bits as four numbers: whether each byte stands there an odd number of times.

    Two sets differ in at least as many members as the parities of their members' bytes differ in bits (``may_be_similar``).
    """
    return np.packbits((np.bincount(places, minlength=256) & 1).astype(np.uint8), bitorder="little").view("<i8")


def may_be_similar(a: str, b: str, similarity: float) -> str:
    """SQL: whether sets of these sizes and parities (columns ``a``.size, ``a``.odd, and of ``b``) can have that Jaccard similarity; no pair that has it fails."""
    differ = " + ".join(f"bit_count({a}.odd[{i}] ^ {b}.odd[{i}])" for i in range(4))
    return f"{differ} <= {(1 - similarity) / (1 + similarity)!r}D * ({a}.size + {b}.size) + 1e-9D"


def parities_udf():
    """Hashes of a set's members -> ``parities`` of their low bytes."""

    @F.pandas_udf("array<long>")
    def odd(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in sets:
            yield pd.Series([parities(np.asarray(s, np.int64) & 255) for s in batch], dtype=object)

    return odd


def word_class(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def bands_udf(words: int, bands: Bands):
    """Text -> its class (a 64-bit hash of its words), the SimHash of its distinct shingles cut into bands, 64 of its bits to compare by,
    the number of its distinct shingles and their parities (``parities``)."""
    total = bands.count * bands.bits
    width = -(-max(total, 64) // 128) * 16
    powers = np.int64(1) << np.arange(bands.bits)

    @F.pandas_udf("class long, bands array<long>, rest long, size int, odd array<long>")
    def cut_bands(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            values, rest, sizes, odd = [], np.zeros(len(batch), "<u8"), np.zeros(len(batch), np.int32), []
            classes = np.array([word_class(t) for t in batch], "<u8").view("<i8")
            for i, text in enumerate(batch):
                own = set(shingles(text, words))
                raw = b"".join([xxhash.xxh3_128_digest(s, seed) for s in own for seed in range(width // 16)])
                hashes = np.frombuffer(raw, np.uint8).reshape(-1, width)
                bits = majority(hashes) if own else np.zeros(width, np.uint8)
                sizes[i] = len(own)
                odd.append(parities(hashes[:, 0]))
                values.append(np.unpackbits(bits, bitorder="little")[:total].reshape(bands.count, bands.bits) @ powers)
                rest[i] = bits[-8:].view("<u8")[0]
            yield pd.DataFrame({"class": classes, "bands": values, "rest": rest.view("<i8"), "size": sizes, "odd": odd})

    return cut_bands


def shingle_set_udf(words: int):
    """Text -> sorted 32-bit hashes of its distinct shingles."""

    @F.pandas_udf("array<int>")
    def shingle_set(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.unique(np.array([xxhash.xxh32_intdigest(s) for s in set(shingles(t, words))], "<u4")).view("<i4")
                             for t in batch])

    return shingle_set


def sketch_notes(datasets: DataFrame, words: int, bands: Bands) -> DataFrame:
    """``datasets`` (row, notes and any other columns) -> the same without notes, with class, bands, rest, size and odd."""
    others = [F.col(f"`{c}`") for c in datasets.columns if c != "notes"]
    return datasets.select(*others, bands_udf(words, bands)("notes").alias("s")).select(*others, "s.*")


def similar_notes(sketches: DataFrame, texts: DataFrame, bands: Bands, words: int = 5, similarity: float = 0.8, few: int = 8) -> DataFrame:
    """``sketches`` (row long, class, bands, rest, size, odd) and ``texts`` (row, notes) -> (class, component): groups of notes whose
    shingle sets have a Jaccard similarity of ``similarity`` or more, by chains.

    ``row`` tells rows apart (rows that are equal may share one), ``class`` is the hash of a note's words; a class is in
    the result only if it is linked with another.  A similarity of 0.8 makes two SimHashes differ in about 15 of 100 bits,
    far beyond the radius of one ball over 64 bits.  So bands of the SimHash are dealt to their balls of radius 1 (see
    ``plan_bands``).

    First notes with an equal band are linked, each with the one before it and the first there: that gathers groups of near copies
    with a few links for each note.  Then the balls meet, and only notes of different groups are compared.  At a place of ``few`` notes or
    fewer all are; at a crowded one a note is compared with the one before it (in the order of 64 bits, so that like stands by like)
    and with the first, and what that does not link is found exactly by ``crowded_links`` over the notes of all places that are crowded
    by more than one group.  Pairs whose SimHashes are farther apart than similar notes ever are, and pairs whose sizes and parities rule
    the similarity out, are let go.  The others are kept once and checked by their shingle sets.
    """
    spark = sketches.sparkSession
    classes = cut(sketches.groupBy("class").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("bands", "rest", "size", "odd")]))
    alike = same_band_links(classes, texts, bands, words, similarity)
    first = cut(connected_components(alike).select(F.col("node").alias("class"), "component"))
    release(spark)
    order = W.partitionBy("place").orderBy("rest", "class")
    me = F.struct("class", "rest", "group")
    named = classes.join(first, "class", "left").withColumn("group", F.coalesce("component", "class"))
    places = named.select("class", "rest", "group", F.posexplode("bands").alias("band", "value")).select("class", "rest", "group", F.explode(
        ball(band_place(bands), bands.bits)).alias("place"))
    whole = W.partitionBy("place")
    beside = places.withColumns({
        "here": F.count("*").over(whole), "low": F.min("group").over(whole), "high": F.max("group").over(whole), "before": F.lag(me).over(order),
        "start": F.first(me).over(order), "others": F.collect_list(me).over(order.rowsBetween(1 - few, -1))}).where("low != high")
    crowd = F.col("here") > few
    partners = F.when(crowd, F.array_distinct(F.filter(F.array("before", "start"), lambda o: o.isNotNull()))).otherwise(F.col("others"))
    near_by = F.filter(partners, lambda o: (F.col("group") != o["group"]) & (hamming(F.col("rest"), o["rest"]) <= bands.far(64)))
    # a note of a crowded place is its own partner there
    met = beside.select("class", F.explode(F.when(crowd, F.concat(near_by, F.array(me))).otherwise(near_by)).alias("o"))
    found = cut(met.select(F.least("class", "o.class").alias("a"), F.greatest("class", "o.class").alias("b")).distinct())
    crowded = found.where("a = b").select(F.col("a").alias("class"))
    pairs = found.where("a != b")
    release(spark)
    def of(name: str, alias: str) -> DataFrame:
        return classes.select(F.col("class").alias(name), F.struct("bands", "size", "odd").alias(alias))

    wide = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    apart = F.aggregate(F.zip_with("x.bands", "y.bands", hamming), F.lit(0), lambda s, x: s + x)
    near = cut(wide.where(F.expr(may_be_similar("x", "y", similarity))).where(apart <= bands.far(bands.count * bands.bits)).select("a", "b"))
    sets = shingle_sets(classes, texts, near.select(F.col("a").alias("class")).union(near.select("b")).union(crowded).distinct(), words)
    release(spark)
    alike = cut(alike.union(checked(near, sets, similarity)))
    groups = connected_components(alike).select(F.col("node").alias("class"), "component")
    if crowded.isEmpty():
        return groups
    more = crowded_links(sets.join(crowded, "class", "left_semi"), cut(groups), similarity)
    return connected_components(alike.union(more)).select(F.col("node").alias("class"), "component")


def band_place(bands: Bands) -> Column:
    return F.shiftleft(F.col("band").cast("long"), bands.bits).bitwiseOR(F.col("value"))


def same_band_links(classes: DataFrame, texts: DataFrame, bands: Bands, words: int, similarity: float) -> DataFrame:
    """``classes`` (class, row, bands, rest) -> (a, b): similar notes that have a band in common, each with two partners a band at most."""
    places = classes.select("class", "rest", F.posexplode("bands").alias("band", "value")).select("class", "rest", band_place(bands).alias("place"))
    order, me = W.partitionBy("place").orderBy("rest", "class"), F.struct("class", "rest")
    beside = places.withColumns({"before": F.lag(me).over(order), "start": F.first(me).over(order)}).where("before IS NOT NULL")
    near_by = F.filter(F.array_distinct(F.array("before", "start")), lambda o: hamming(F.col("rest"), o["rest"]) <= bands.far(64))
    met = beside.select("class", F.explode(near_by).alias("o"))
    pairs = cut(met.select(F.least("class", "o.class").alias("a"), F.greatest("class", "o.class").alias("b")).distinct())
    sets = shingle_sets(classes, texts, pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), words)
    return checked(pairs, sets, similarity)


def shingle_sets(classes: DataFrame, texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, shingles) of the ``wanted`` (class), each read from one of its rows."""
    rows = cut(classes.join(wanted, "class", "left_semi").select("row", "class"))
    known = texts.select("row", "notes").join(rows, "row").dropDuplicates(["class"])
    return cut(known.select("class", shingle_set_udf(words)("notes").alias("shingles")))


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (class, shingles) have a Jaccard similarity of ``similarity`` or more."""
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("shingles").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return cut(both.where(shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b"))


def crowded_links(sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """``sets`` (class, shingles) -> (a, b): every pair of a similarity of ``similarity`` or more whose notes are not in one of
    ``groups`` (class, component) already.

    An exact prefix-filter join.  With shingles ordered from rare to common, two such sets share one of the first shingles of
    the smaller (so many as a partner of its own size or more may lack, and one) and of the larger (so many as any partner may lack,
    and one).  What a whole family of less similar texts shares comes after these.  A shingle whose notes are all in one
    group asks for nothing, and no two notes of a shingle's largest group are paired: so a group of copies makes no pairs.  The join itself
    looks at the parities of both sets, so notes of a family that are less similar meet there but make no rows.
    """
    odd = cut(sets.select("class", parities_udf()("shingles").alias("odd")))
    tokens = sets.select("class", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    # the sums with 0 give the joins exchanges of their own, which adaptive execution can split
    times = tokens.groupBy("token").agg(F.count("*").alias("n")).select((F.col("token") + F.lit(0)).alias("token"), "n")
    ranked = tokens.join(times, "token").groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    least = F.lit(2 * similarity / (1 + similarity))
    lead = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
    reach = (F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1).cast("int")
    entries = ranked.select("class", "size", lead.alias("lead"), F.posexplode(F.slice("ranked", F.lit(1), reach)).alias("at", "t")).where("t.n > 1")
    grouped = groups.select((F.col("class") + F.lit(0)).alias("class"), "component")
    entries = cut(entries.join(odd.select((F.col("class") + F.lit(0)).alias("class"), "odd"), "class").join(grouped, "class", "left").select(
        "class", "size", "odd", F.coalesce("component", "class").alias("group"), (F.col("at") < F.col("lead")).alias("leads"), F.col("t.token").alias("token")))
    parts = entries.groupBy("token", "group").count().groupBy("token").agg(F.max(F.struct("count", "group")).alias("m"), F.count("*").alias("groups"))
    lists = parts.where("groups > 1").select((F.col("token") + F.lit(0)).alias("token"), F.col("m.group").alias("largest"))
    live = cut(entries.join(lists, "token"))
    one = live.where("group != largest").drop("largest").alias("x")
    fits = F.expr(f"(x.leads AND x.size <= y.size AND x.size >= {similarity} * y.size - 1e-9D) OR (y.leads AND y.size <= x.size AND y.size >= {similarity} * x.size - 1e-9D)")
    met = one.join(live.alias("y"), F.col("x.token") == F.col("y.token")).where(F.col("x.group") != F.col("y.group")).where(fits).where(F.expr(may_be_similar("x", "y", similarity)))
    pairs = cut(met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct())
    release(sets.sparkSession)
    return checked(pairs, sets, similarity)


def one_of_each(datasets: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``datasets`` (id, notes and any other columns) less all but one of each group of similar notes.

    The row with the smallest id stays (rows with a null id only if all have none; of rows with that id the one
    whose columns hash lowest; of rows that are equal in every column one).  Blank and null notes are one group.
    """
    row = fresh(datasets, "_row")
    tagged = datasets.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in datasets.columns]))
    known = tagged.select("id", F.col(row).alias("row"), "notes")
    bands = plan_bands(known.agg(F.approx_count_distinct(F.xxhash64("notes"))).first()[0], similarity)
    small = cut(sketch_notes(known, words, bands))
    groups = similar_notes(small, known, bands, words, similarity)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    keep = small.join(groups, "class", "left").groupBy(F.coalesce("component", "class").alias("group")).agg(F.min(first).alias("k"))
    keep = cut(keep.select(F.col("k.row").alias("row")))
    release(datasets.sparkSession)
    again = cut(small.join(keep, "row", "left_semi").groupBy("row").count().where("count > 1").select(F.col("row").alias(row)))
    kept = tagged.join(keep.withColumnRenamed("row", row), row, "left_semi")
    if again.isEmpty():
        return kept.drop(row)
    return kept.join(again, row, "left_anti").unionByName(kept.join(again, row, "left_semi").dropDuplicates([row])).drop(row)
