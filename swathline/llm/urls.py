"""URL filters: reversed-host keys, prefix intervals and one sorted sweep (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import carried, cut, dealt_by_range

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACTIVE = "struct<length:int,host:string,path:string,verdict:string>"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(labels: Column, path: Column) -> Column:
    """Bytes of the labels from the right, each ended by ``?`` (which neither a host nor a path has), then the path."""
    return F.concat(F.array_join(F.reverse(labels), "?"), F.lit("?"), path).cast("binary")


def judge_webhooks(webhooks: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``webhooks`` (id, url) -> (id, url, host, path, rule, verdict), one row for each row given.

    ``rules``: host, path, verdict.  A rule fits its host and all subdomains when the url's path starts with
    the rule's path; the longest host + path wins (of equally long ones the longer host, then the host, path
    and verdict that sort last).  ``rule`` is that host + path, null when none fits; the verdict is then
    ``default``.

    Every rule is an interval of canonical keys (reversed host, then path), and intervals are nested or apart.
    A url asks with one key for each of its parent hosts, as many as the longest rule host has labels, and
    with as much of its path as the longest rule path has.  Keys, interval starts and interval ends are dealt
    by range and swept in order: a start makes its rule the innermost, an end gives back the enclosing one,
    which the rules' own nesting tells beforehand, so the top of the stack is a running last value.  Equal
    questions are asked once, however many urls share a host.

    A url that is null or has no ``://`` has an empty host and path and no rule.  Rules that cannot fit any url
    are left out (null or empty host, null path or verdict, a ``?`` or ``#``, a ``/`` in the host); a rule
    given twice counts once.  Empty tables give no rows, or no rules.  Other columns are not looked at.
    """
    urls = webhooks.select("id", "url").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    known = _rules(rules)
    most = known.agg(F.max(F.size(F.split("host", r"\."))).alias("_depth"), F.max(F.length("path")).alias("_reach"))
    asked = urls.crossJoin(F.broadcast(most)).withColumn("_cut", F.expr("substring(path, 1, coalesce(_reach, 0))"))
    ask = asked.where("host != '' AND _depth IS NOT NULL").select("host", "_cut", "_depth").distinct()
    labels = F.split("host", r"\.")
    keys = ask.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), "_depth")))).select(
        canonical(F.slice(labels, -F.col("_n"), F.col("_n")), F.col("_cut")).alias("key"), F.lit(1).alias("kind"),
        "host", "_cut", F.lit(None).cast(ACTIVE).alias("active"))
    events = dealt_by_range(keys.unionByName(_events(known)), ["key", "kind", "host", "_cut"], "_part")
    swept = carried(events, "_part", [F.col("key"), F.col("kind"), F.col("host"), F.col("_cut")], "active", "top")
    best = (swept.where("kind = 1 AND top.verdict IS NOT NULL").groupBy("host", "_cut")
            .agg(F.max(F.struct("top.length", F.length("top.host").alias("by_host"), "top.host", "top.path",
                                "top.verdict")).alias("best")))
    found = best.select(F.concat("host", F.lit("")).alias("host"), "_cut", "best")
    judged = asked.join(found, ["host", "_cut"], "left")
    return judged.select("id", "url", "host", "path", F.concat("best.host", "best.path").alias("rule"),
                         F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _rules(rules: DataFrame) -> DataFrame:
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where(
        r"host != '' AND verdict IS NOT NULL AND path IS NOT NULL AND host NOT RLIKE '[/?#]' AND path NOT RLIKE '[?#]'")
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return cut(one.withColumn("key", canonical(F.split("host", r"\."), F.col("path"))))


def _events(rules: DataFrame) -> DataFrame:
    """Starts (kind 0) and ends (kind 2) of the rules' intervals, with the rule that is innermost from there on.

    The enclosing rule is the longest other rule whose key is a prefix, found by an equality join with all
    shorter prefixes.  Where nothing encloses, the end carries a rule without a verdict.  No text has the byte
    FF, so a key and FF come after all that begins with the key.
    """
    own = rules.select("key", F.struct((F.length("host") + F.length("path") + 1).alias("length"), "host", "path", "verdict").cast(ACTIVE).alias("active"))
    shorter = rules.where("length(key) > 1").select(
        F.col("key").alias("inner"), F.expr("explode(transform(sequence(1, length(key) - 1), n -> substring(key, 1, n)))").alias("key"))
    outer = shorter.join(own, "key").groupBy("inner").agg(F.max("active").alias("outer"))
    nested = own.join(outer.withColumnRenamed("inner", "key"), "key", "left")
    none = F.expr("named_struct('length', 0, 'host', null, 'path', null, 'verdict', null)").cast(ACTIVE)
    nothing = F.lit(None).cast("string")
    starts = nested.select("key", F.lit(0).alias("kind"), nothing.alias("host"), nothing.alias("_cut"), "active")
    ends = nested.select(F.expr("concat(key, X'FF')").alias("key"), F.lit(2).alias("kind"), nothing.alias("host"),
                         nothing.alias("_cut"), F.coalesce("outer", none).alias("active"))
    return starts.unionByName(ends)
