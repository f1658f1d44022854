"""Top-k search and url filters against brute force."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.llm import topk, urls
from swathline.llm.queries import QUERIES, SQL
from tests.conftest import FOLDER
from tools.check_sql import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    problem, _ = compare(QUERIES[name](spark, FOLDER), con, SQL[name])
    assert problem is None


def brute(vectors, asked, k):
    out = set()
    for q, v in asked:
        order = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(order)}
    return out


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_top_descriptors_with_ties_blocks_and_repeats(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-20, 20, (400, 8))
    base[100:220] = base[7]  # a very common vector
    base[300] = 0
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    extra = [(None, [1] * 8), (900, None)]
    df = spark.createDataFrame([(*r, "x") for r in vectors + extra], "desc_id long, vec array<long>, score string").repartition(3)
    got = topk.top_descriptors(df.where("desc_id % 20 = 0"), df, k=5, pivots=6, query_block=8, block=64, first=8)
    assert rows(got) == brute(vectors, [x for x in vectors if x[0] % 20 == 0], 5)


def test_top_descriptors_of_few_large_or_no_vectors(spark):
    few = [(0, [2 ** 30, -3]), (20, [1, 1]), (21, [-(2 ** 30), 5])]
    df = spark.createDataFrame(few, "desc_id long, vec array<long>")
    assert rows(topk.top_descriptors(df, df, k=20)) == brute(few, few, 20)
    assert rows(topk.top_descriptors(df.limit(0), df)) == set()
    assert rows(topk.top_descriptors(df, df.limit(0))) == set()


def test_whole_vectors_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(0, [0.5, -0.01]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, None), (5, [])],
                               "desc_id long, e array<float>")
    got = {r.desc_id: r.vec for r in df.select("desc_id", topk.whole_vectors(F.col("e")).alias("vec")).collect()}
    assert got == {0: [32, -1], 1: None, 2: None, 3: None, 4: None, 5: None}


def judged(url, rules, default):
    rest = url.partition("://")[2] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h) + 1 + len(p), len(h), h, p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else default


def test_judge_webhooks_with_nested_rules(spark):
    rnd = random.Random(2)
    labels, steps = ["a", "b", "-a", "0", "com", "net", "é"], ["", "/", "/x", "/x/", "/x/y", "/é"]
    rules = list({(".".join(rnd.choices(labels, k=rnd.randint(1, 3))), rnd.choice(steps)): rnd.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls_ = [f"http://{'.'.join(rnd.choices(labels, k=rnd.randint(1, 5)))}{rnd.choice(steps)}{rnd.choice(['', 'z', '?q=/x', '#/x', '?://'])}" for _ in range(400)]
    urls_ += [None, "", "no scheme", "://", "http://", "HTTP://A.COM/x", "http://a..com/x", "http://" + "a." * 3000 + "com/x", urls_[0], "http://a?://b.com/x"]
    hooks = spark.createDataFrame([(i % 380, u, "clash") for i, u in enumerate(urls_)], "id long, url string, host string")
    odd = [("", "/", "block"), (None, "/", "block"), ("a/b", "/", "block"), ("a", "?", "block"), ("a", None, "block"), ("b", "/", None)]
    df = spark.createDataFrame(rules + rules[:3] + odd, "host string, path string, verdict string")
    got = sorted((r.id, r.url or "", r.host, r.path, r.rule or "", r.verdict) for r in urls.judge_webhooks(hooks, df, "allow").collect())
    want = sorted((i % 380, u or "", *[x or "" for x in judged(u, rules, "allow")]) for i, u in enumerate(urls_))
    assert got == want


def test_judge_webhooks_without_rules_or_rows(spark):
    hooks = spark.createDataFrame([(1, "http://a.com/")], "id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urls.judge_webhooks(hooks, none, "block").collect()] == [(1, "http://a.com/", "a.com", "/", None, "block")]
    assert urls.judge_webhooks(hooks.limit(0), none).collect() == []
