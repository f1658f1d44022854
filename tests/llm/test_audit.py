"""Filter audit, ranked search and toxicity against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.llm import audit, ranked, toxicity
from swathline.llm.queries import QUERIES
from tests.conftest import FOLDER

DATASETS = "id long, org_id string, notes string, fails int, good int, label string, survivors string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit -------------------------------------------------------------------------------------------------


def fails_of(rows):
    first = {}
    for i, _, t in rows:
        key = math.inf if i is None else i
        first[t or ""] = min(first.get(t or "", math.inf), key)
    out = []
    for i, _, t in rows:
        t = t or ""
        words = BLANK.findall(t)
        out.append({"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                    "D": bool(re.search(r"[#$%&*|]", t)), "E": (math.inf if i is None else i) > first[t]})
    return out


def audit_by_hand(rows, reviews):
    fails, out = fails_of(rows), {}
    good = {i for i, g, _ in reviews if g == 1 and i is not None}
    toxic = {i for i, _, x in reviews if x == 1 and i is not None}
    for part in {r[1] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[1] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                removed, kept = [r for r in left if r[1][x]], [r for r in left if not r[1][x]]
                shapley[x] += len(removed)
                out[part, "".join(order), step] = [len(kept), len(removed), sum(r[1][x] for r in gone), sum(r[1][x] and sum(r[1].values()) == 1 for r in own),
                                                   sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed), x]
                left, gone = kept, gone + removed
        for key in [k for k in out if k[0] == part]:
            out[key][6] = shapley[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


def notes_of_all_kinds(rnd, n):
    words = ["survey", "of", "the", "field", "Flight", "MAP", "50%", "a|b", "é😀", "x y", " ", "z"]
    rows = [(1, None, None), (2, None, ""), (3, "north", "\t \x0b\n"), (4, "", "A"), (4, "north", "A"), (None, "north", "A"), (None, "south", "A"),
            (5, "south", "long " * 150_000 + "tail"), (5, "south", "long " * 150_000 + "tail"), (6, "north", "long " * 150_000 + "tail")]
    for i in range(n):
        rows.append((rnd.randint(0, 300), rnd.choice(["north", "south", "x' y", None]), " ".join(rnd.choices(words[:rnd.randint(1, 12)], k=rnd.choice([0, 3, 199, 200, 400])))))
    return rows


def test_filter_audit_against_a_sequential_run(spark):
    rnd = random.Random(3)
    rows = notes_of_all_kinds(rnd, 250)
    reviews = [(rnd.randint(0, 300), rnd.randint(0, 1), rnd.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1), (4, 0, 1), (4, 1, 0)]
    datasets = spark.createDataFrame([(*r, 7, 7, "x", "y") for r in rows], DATASETS).repartition(7)
    got = audit.filter_audit(datasets, spark.createDataFrame([(*r, "z") for r in reviews], "id long, good int, toxic int, org_id string")).collect()
    want = audit_by_hand(rows, reviews)
    assert len(got) == len(want) == 4 * 600
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got} == want


def test_filter_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], DATASETS)
    assert audit.filter_audit(none, spark.createDataFrame([], "id long, good int, toxic int")).count() == 0
    one = audit.filter_audit(spark.createDataFrame([(1, "a", "x")], "id long, org_id string, notes string"), spark.createDataFrame([], "id long, good int, toxic int"))
    assert one.count() == 600 and one.agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 100, 4097])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 2 ** 32, n, dtype=np.uint32)
    assert audit.positional_popcount(words).tolist() == [int((words >> s & 1).sum()) for s in range(32)]


def test_a_survival_word_is_the_truth_table_of_its_failures():
    for fails in range(32):
        assert [bool(int(audit.WORDS[fails]) >> s & 1) for s in range(32)] == [all(not (s >> b & 1 and fails >> b & 1) for b in range(5)) for s in range(32)]


def test_a_copy_of_a_third_of_the_rows_meets_no_single_task(spark):
    rows = [(i, "a", "copy" if i % 3 == 0 else f"own {i}") for i in range(3000)]
    df = audit.failed_filters(spark.createDataFrame(rows, "id long, org_id string, notes string"))
    assert df.where("fails >= 16").count() == 999
    plan = df._jdf.queryExecution().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- ranked search ------------------------------------------------------------------------------------------------


def terms_of(text):
    return [w.translate(str.maketrans(ranked.UPPER, ranked.LOWER)) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranking_by_hand(notes, searches, k):
    docs = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in notes]
    docs = [d for d in docs if d[2]]
    n_docs, total = len(docs), sum(d[2] for d in docs)
    df = Counter(w for d in docs for w in d[1])
    asked = {}
    for s, t in searches:
        if s is not None:
            asked.setdefault(s, set()).update(terms_of(t))
    out = []
    for s, words in asked.items():
        rows = []
        for i, tf, n in docs:
            m = 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in words if tf[w])
            if score > 0 and i is not None:
                rows.append((-score, i))
        out += [(s, r, i, -x) for r, (x, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def ranking_case(rnd):
    words = ["map", "maps", "amap", "map2", "été", "ÉTÉ", "Ünder", "x y", "\x85", "field", "nir", "😀", "a", "b", "c"]
    marks = [" ", ", ", "-", "_", "\n", "\x00", "/", ".."]
    text = lambda n: "".join(w + rnd.choice(marks) for w in rnd.choices(words, k=n))
    notes = [(rnd.randint(-50, 400), text(rnd.choice([0, 1, 5, 40])).swapcase() if rnd.random() < .3 else text(rnd.randint(0, 30))) for _ in range(300)]
    notes += [(1000, None), (1001, ""), (1002, "-- ..."), (None, "map field"), (7, "map map"), (7, "map map"), (8, "map " * 60_000), (9, "map map"), (10, "map map")]
    searches = [(i, text(rnd.randint(0, 12))) for i in range(25)] + [(3, "map"), (40, None), (41, ""), (42, "unknownterm"), (43, "MAP"), (None, "map")]
    return notes, searches


def test_ranked_datasets_against_brute_force(spark, monkeypatch):
    notes, searches = ranking_case(random.Random(5))
    data = spark.createDataFrame([(*r, 1, "x", 2.0) for r in notes], "id long, notes string, n int, term string, score double").repartition(6)
    asked = spark.createDataFrame([(*r, 1) for r in searches], "search_id long, search string, rank int")
    want = ranking_by_hand(notes, searches, 20)
    for most, cells in ((ranked.BLOCK_BYTES, ranked.CELLS), (60, 64)):
        monkeypatch.setattr(ranked, "CELLS", cells)
        monkeypatch.setattr(ranked.search_blocks, "__defaults__", (most,))
        assert sorted(tuple(r) for r in ranked.ranked_datasets(data, asked, 20).collect()) == want


def test_ranked_datasets_of_empty_tables(spark):
    notes, asked = "id long, notes string", "search_id long, search string"
    assert ranked.ranked_datasets(spark.createDataFrame([], notes), spark.createDataFrame([(1, "map")], asked)).count() == 0
    assert ranked.ranked_datasets(spark.createDataFrame([(1, "map")], notes), spark.createDataFrame([], asked)).count() == 0


# --- toxicity -----------------------------------------------------------------------------------------------------


def grams_by_hand(text):
    folded = bytes(int(b) for b in toxicity.FOLD[np.frombuffer(b" " + text.encode() + b"  ", np.uint8)])
    out = set()
    for i in range(len(folded)):
        for n in toxicity.GRAMS:
            g = folded[i:i + n]
            if len(g) == n:
                h = g[0] << 16 | g[1] << 8 | g[2]
                for b in g[3:]:
                    h = h * 0x01000193 % 2 ** 32 ^ b
                out.add((h * 0x9E3779B1 + n) * 0x85EBCA6B % 2 ** 32 >> 12)
    return out


def test_scores_against_naive_features(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abc dé1.😀\n", k=rnd.choice([0, 1, 2, 5, 60, 900]))) for _ in range(60)] + ["", "a" * 5000]
    hashes = np.array(sorted(rnd.sample(sorted(set().union(*map(grams_by_hand, texts))), 200)))
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(hashes, rng.normal(0, 0.3, (2, 200)), np.array([-0.5, 0.2]))
    want = [np.mean([1 / (1 + math.exp(-(b + sum(w[j] for j, h in enumerate(hashes) if h in grams)))) for w, b in zip(model.weights, model.bias)])
            for grams in map(grams_by_hand, texts)]
    for size in (1 << 20, 64):
        monkeypatch.setattr(toxicity.texts_in_chunks, "__defaults__", (size,))
        assert np.allclose(model.scores(texts, model.places()), want)


def test_the_gradient_is_that_of_the_non_negative_risk():
    rng = np.random.default_rng(5)
    xp, xu, w, prior = rng.random((20, 4)) < .5, rng.random((30, 4)) < .4, rng.normal(0, 1, 5), 0.3
    value = lambda t: sum(toxicity.risk(xp @ t[:-1] + t[-1], xu @ t[:-1] + t[-1], prior))
    numeric = np.array([(value(w + d) - value(w - d)) / 2e-6 for d in 1e-6 * np.eye(5)])
    sp, su = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) for x in (xp, xu))
    gp, gu = prior * (sp - 1) / 20 - prior * sp / 20, su / 30
    assert np.allclose(numeric, np.append(gp @ xp + gu @ xu, gp.sum() + gu.sum()), atol=1e-5)


def toxic_table(n=2400, seed=4):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choices("aeioulnrst", k=rnd.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words, toxic = rnd.choices(plain, k=rnd.randint(20, 200)), rnd.random() < .15
        if toxic:
            for w in rnd.choices(["vexgob", "vexgobs", "krumpling"], k=3):
                words.insert(rnd.randrange(len(words)), w)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_notes_are_told_apart(spark):
    rows = toxic_table()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = spark.createDataFrame([(i, t, (x if random.Random(i).random() < .6 else None), 1.0) for i, t, x in rows if not held(i)], "id long, notes string, toxic int, score double")
    model = toxicity.fit_toxicity(known)
    got = {r.id: r for r in toxicity.notes_toxicity(spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "id long, notes string, toxic int"), model).collect()}
    out = [(got[i].toxic, x) for i, _, x in rows if held(i)]
    found, right = sum(p for p, _ in out), sum(p and x for p, x in out)
    assert right >= 0.9 * sum(x for _, x in out) and right >= 0.95 * found
    assert all(0 <= r.score <= 1 and r.toxic == (r.score >= 0.7) for r in got.values())


def test_odd_notes_and_missing_labels(spark):
    rows = [(1, None, 1), (2, "", 0), (None, "vexgob", 1), (3, "vexgob", 1), (3, "vexgob", 1), (4, "plain " * 200_000, None)]
    data = spark.createDataFrame(rows, "id long, notes string, toxic int")
    model = toxicity.fit_toxicity(data)
    got = toxicity.notes_toxicity(data, model).collect()
    assert len(got) == 6 and all(r.score is not None for r in got)
    for none in (data.where("false"), data.where("toxic = 0"), data.withColumn("toxic", F.lit(None).cast("int"))):
        empty = toxicity.fit_toxicity(none)
        assert {r.score for r in toxicity.notes_toxicity(data, empty).collect()} == {0.0}
    assert toxicity.notes_toxicity(data.where("false"), model).count() == 0
    assert toxicity.fit_toxicity(data.where("toxic = 1")).bias is not None


def test_the_queries_columns(spark):
    out = QUERIES["op11_notes_toxicity"](spark, FOLDER)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
