"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.llm.common import fresh

#: Fixed patterns, in the order in which kinds are listed: kind -> pattern.  What they find is still tested by ``passes``.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""(?i:^(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the test asks for would be dropped, and a run's matches never overlap another's, so the
#: length is part of these two patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the Markov models judge: runs of identifier characters with a letter.
RUN = "[A-Za-z0-9_+/=-]"
WORD = f"(?<!{RUN})(?={RUN}*?[A-Za-z]){RUN}{{12,}}"
KINDS = ("assign", "access", "hex", "random")
FOUND = "cast(array() AS array<struct<start:int,kind:int,end:int,found:string>>)"
ALPHABET = 128
#: Matches of a text that are put in place together.
BLOCK = 200


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches that do not overlap, as structs (start, kind, end, found); places are code points.

    What stands between the matches is ``split`` by the same pattern, so a match begins after all earlier
    pieces and matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    none = F.expr(FOUND)

    def step(s: Column, pair: Column) -> Column:
        start = s["at"] + pair["gap"]
        end = start + F.length(pair["found"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    def block(s: Column, pairs: Column) -> Column:
        done = F.aggregate(pairs, F.struct(s["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(s["out"], F.array(done["out"])).alias("out"))

    pairs = F.zip_with(found, F.slice(sizes, 1, F.size(found)), lambda f, g: F.struct(g.alias("gap"), f.alias("found")))

    def placed(pairs: Column) -> Column:
        """Arrays grow inside blocks of ``BLOCK`` matches, so a text with very many costs little more for each."""
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(pairs, i, F.lit(BLOCK)))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array(none).alias("out")), block, lambda s: F.flatten(s["out"]))

    # an array of one, so that the pairs are worked out once
    return F.transform(F.array(pairs), placed)[0]


def passes(span: Column) -> Column:
    return (span["kind"] != 0) | (F.length(F.regexp_extract(span["found"], VALUE, 1)) >= 8)


def base_spans(text: Column) -> Column:
    every = F.concat(spans_of(text, ASSIGN, 0), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2))
    return F.filter(every, passes)


# --- the two Markov models ----------------------------------------------------------------------------------------


def labelled_samples(jobs: DataFrame, notes: int = 4000) -> DataFrame:
    """``jobs`` (id, error_message) -> (sample, random): strings to train on, labelled by rule.

    Random: values that a pattern finds (a key's value, an access key, a hexadecimal run).  Ordinary: words of letters,
    hyphens and underscores of four or more characters, and the names that a platform makes of them (``names_of``).  Both come from the ``notes`` messages with the lowest hash that
    have a pattern's match, and as many of the others: that bounds the sample.
    """
    text = F.coalesce("error_message", F.lit(""))
    keyed = jobs.select(F.xxhash64(text).alias("_h"), text.alias("text"))
    marked = keyed.select("_h", F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}").alias("_hit"), F.pmod("_h", F.lit(64)).alias("_s"))
    rank = F.row_number().over(W.partitionBy("_hit", "_s").orderBy("_h"))
    chosen = marked.groupBy("_h", "_hit", "_s").count().withColumn("_r", rank).where(F.col("_r") <= notes // 64)
    texts = keyed.join(chosen.select("_h", "_hit"), "_h").dropDuplicates(["_h"])
    hits = texts.where("_hit").select(F.explode(base_spans(F.col("text"))).alias("s"))
    value = F.when(F.col("s.kind") == 0, F.regexp_extract("s.found", VALUE, 1)).otherwise(F.col("s.found"))
    random = hits.select(value.alias("sample"), F.lit(True).alias("random"))
    words = F.filter(F.split("text", r"[^A-Za-z_-]+"), lambda w: F.length(w) >= 4)
    plain = texts.select(F.explode(F.concat(words, F.transform(words, names_of))).alias("sample"), F.lit(False).alias("random"))
    return random.union(plain)


def names_of(word: Column, place: Column) -> Column:
    """An ordinary name with digits made of ``word``, the kind dealt by its hash: a counted file, a dated run, a size and a
    version, a capture in capitals, a time, a joined name.  Numbers come from the hash of the word and its place."""
    drawn = F.xxhash64(word, place)

    def number(digits: int, shift: int) -> Column:
        return F.lpad(F.pmod(F.shiftrightunsigned(drawn, shift), F.lit(10 ** digits)).cast("string"), digits, "0")

    date = F.concat(F.lit("20"), number(2, 3), F.lpad((F.pmod(F.shiftrightunsigned(drawn, 7), F.lit(12)) + 1).cast("string"), 2, "0"),
                    F.lpad((F.pmod(F.shiftrightunsigned(drawn, 11), F.lit(28)) + 1).cast("string"), 2, "0"))
    parted = F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))
    clock = F.concat(F.lit("T"), number(2, 17), F.lit("-"), number(2, 23), F.lit("-"), number(2, 29), F.lit("Z"))
    kinds = [F.concat(word, F.lit("_"), number(4, 5), F.lit("_"), word), F.concat(word, F.lit("-"), parted),
             F.concat(word, F.lit("_"), number(1, 5), F.lit("cm_v"), number(2, 9)),
             F.concat(F.upper(word), F.lit("_"), date, F.lit("_"), F.upper(word)), F.concat(parted, clock),
             F.concat(F.initcap(word), F.initcap(word), number(2, 5)), F.concat_ws("_", word, F.substring(date, 1, 4), number(3, 13))]
    return F.get(F.array(*kinds), F.pmod(F.shiftrightunsigned(drawn, 40), F.lit(len(kinds))).cast("int"))


def character_model(samples: DataFrame, smooth: float = 4.0) -> list[float]:
    """``samples`` (sample, random) -> log-likelihood ratio of each pair of ASCII characters, at 128 * first + second.

    Two first-order models, one of the random strings and one of the ordinary ones.  What a character is followed by is
    smoothed by ``smooth`` draws from how often characters occur at all, so a pair that was never seen still tells
    by its second character.  Without samples of both kinds nothing looks random.  The table has 16,384 numbers,
    whatever the samples.
    """
    clean = samples.where("sample IS NOT NULL AND random IS NOT NULL AND sample RLIKE '^[\\\\x21-\\\\x7e]{2,}$'")
    pair = F.expr("explode(transform(sequence(1, length(sample) - 1), i -> substring(sample, i, 2)))")
    seen = {kind: [[0.0] * ALPHABET for _ in range(ALPHABET)] for kind in (True, False)}
    for r in clean.select("random", pair.alias("pair")).groupBy("random", "pair").count().collect():
        seen[r["random"]][ord(r["pair"][0])][ord(r["pair"][1])] = float(r["count"])
    if not all(any(map(any, table)) for table in seen.values()):
        return [0.0] * (ALPHABET * ALPHABET)

    def logs(table: list[list[float]]) -> list[float]:
        ends = [sum(row[b] for row in table) + 0.5 for b in range(ALPHABET)]
        total = sum(ends)
        return [math.log((row[b] + smooth * ends[b] / total) / (sum(row) + smooth)) for row in table for b in range(ALPHABET)]

    return [p - q for p, q in zip(logs(seen[True]), logs(seen[False]), strict=True)]


def likelihood_ratio(word: Column, model: list[float]) -> Column:
    """Sum over the pairs of neighbouring characters of ``word`` (ASCII)."""
    table = F.lit(model)
    code = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, F.lit(2), F.size(code) - 1), lambda a, b: a * ALPHABET + b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.coalesce(F.get(table, i), F.lit(0.0)))


def random_spans(text: Column, model: list[float], per_pair: float = 0.6) -> Column:
    """Runs of ``WORD`` that look random: the ratio is above ``per_pair`` for each pair of characters."""
    return F.filter(spans_of(text, WORD, 3), lambda s: likelihood_ratio(s["found"], model) > per_pair * (F.length(s["found"]) - 1))


def apart(added: Column, base: Column) -> Column:
    """The ``added`` spans that no ``base`` span has a part of.  Base spans are looked at in blocks by start, so a text with very many costs little more for each."""
    ordered = F.array_sort(base)

    def summed(items: Column) -> Column:
        return F.struct(F.get(items, 0)["start"].alias("low"), F.array_max(F.transform(items, lambda s: s["end"])).alias("high"), items.alias("items"))

    def meets(one: Column, start: Column, end: Column) -> Column:
        return F.coalesce((start < one["end"]) & (one["start"] < end), F.lit(False))

    def touches(blocks: Column, one: Column) -> Column:
        return F.exists(blocks, lambda k: meets(one, k["low"], k["high"]) & F.exists(k["items"], lambda s: meets(one, s["start"], s["end"])))

    blocks = F.transform(F.array(ordered), lambda all_: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(BLOCK)), lambda i: F.transform(F.array(F.slice(all_, i, F.lit(BLOCK))), summed)[0]))[0]
    return F.transform(F.array(F.struct(added.alias("a"), blocks.alias("k"))), lambda x: F.filter(x["a"], lambda one: ~touches(x["k"], one)))[0]


def spans_column(text: Column, model: list[float]) -> Column:
    """All spans of a text as structs (start, kind number, end), by start, then kind; none for a null text.

    What the models find is added where no pattern's span has a part of it; the patterns' spans stay as they are.
    """
    whole = F.coalesce(text, F.lit(""))
    likely = whole.rlike(f"{ASSIGN}|{ACCESS}|{HEX}")
    base = F.when(likely, base_spans(whole)).otherwise(F.expr(FOUND))
    added = F.when(whole.rlike(WORD), random_spans(whole, model)).otherwise(
        F.expr(FOUND))
    both = F.transform(F.array(F.struct(base.alias("b"), added.alias("a"))), lambda x: F.concat(x["b"], apart(x["a"], x["b"])))[0]
    return F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def secret_spans(jobs: DataFrame, model: list[float]) -> DataFrame:
    """``jobs`` (id, error_message) -> (id, spans), one row for each row given.

    ``spans``: array of (start, kind, end) by start, then kind; kind 0 to 3 is assign, access, hex, random (``KINDS``); places
    are code points, the end is exclusive.  A null message has no spans.  Repeated rows come out as often as they go in; an
    empty table gives no rows.  Other columns are not looked at.
    """
    return jobs.select("id", spans_column(F.col("error_message"), model).alias("spans"))


def redact(jobs: DataFrame, model: list[float], mark: str = "[secret]") -> DataFrame:
    """``jobs`` with every secret span of ``error_message`` replaced by ``mark``; overlapping spans get one mark.

    All rows and columns stay; a message without a secret stays as it is, null included.
    """
    name = fresh(jobs, "_spans")
    text = F.col("error_message")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, span["start"] - s["at"])
        mine = F.when(span["start"] >= s["at"], F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), mine.alias("out"))

    clean = F.aggregate(name, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return jobs.withColumn(name, spans_column(text, model)).withColumn(
        "error_message", F.when(F.size(name) > 0, clean).otherwise(text)).drop(name)


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
