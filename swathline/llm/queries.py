"""The queries of this folder: each maps the given tables to an operator's records and its results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.llm import audit, fingerprints, language, licenses, packing, pieces, ppm, ranked, secrets, simhash, topk, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as datasets with notes."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("notes"))


# --- 1 ------------------------------------------------------------------------------------------------------------


def _values(rows: list[tuple[str, str]], units: str) -> str:
    return ", ".join("('{}', '{}', {})".format(*[v.replace("'", "''") for v in r], units) for r in rows)


TERMS_SQL = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
LICENSE_SQL = f"""WITH f AS (SELECT doc_id, coalesce(text, '') AS t, concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', doc_id // 100) AS folder,
  CASE WHEN doc_id % 100 = 0 THEN 'NOTICE' ELSE doc_id || '.txt' END AS name FROM documents),
tp(license, body, units) AS (VALUES {_values(licenses.TEMPLATES, "true")}, {_values(licenses.header_phrases(), "false")}),
tw AS (SELECT license, body, units, {TERMS_SQL.format("body")} AS ws FROM (SELECT DISTINCT * FROM tp)),
tt AS (SELECT license, body, units, w, count(*) AS c FROM (SELECT license, body, units, unnest(ws) AS w FROM tw) GROUP BY ALL),
df AS (SELECT w, count(*) AS d FROM (SELECT doc_id, unnest(list_distinct({TERMS_SQL.format("t")})) AS w FROM f) WHERE w IN (SELECT w FROM tt) GROUP BY w),
n AS (SELECT count(*) AS n FROM f),
idf AS (SELECT w, ln((1 + n) / (1 + coalesce(d, 0))) + 1 AS idf FROM (SELECT DISTINCT w FROM tt) LEFT JOIN df USING (w), n),
tv AS (SELECT license, body, units, w, c * idf AS x, sqrt(sum((c * idf) ** 2) OVER (PARTITION BY license, body, units)) AS norm FROM tt JOIN idf USING (w)),
u AS (SELECT doc_id, unit, unit = t AS whole FROM (SELECT doc_id, t, unnest(list_distinct([t] || string_split(t, chr(10)) || regexp_split_to_array(t, '\\n[ \\t\\r]*\\n'))) AS unit FROM f)),
uw AS (SELECT doc_id, unit, whole, w, count(*) AS c FROM (SELECT *, unnest({TERMS_SQL.format("unit")}) AS w FROM u) GROUP BY ALL),
ux AS (SELECT doc_id, unit, whole, w, c * coalesce(idf, ln(1 + n) + 1) AS x FROM uw LEFT JOIN idf USING (w), n),
un AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id, unit)) AS unorm FROM ux),
an AS (SELECT license, body, units, w FROM (SELECT license, body, units, w, row_number() OVER (PARTITION BY license, body, units ORDER BY coalesce(d, 0), w) AS k,
  count(*) OVER (PARTITION BY license, body, units) AS words FROM tt LEFT JOIN df USING (w)) WHERE k <= words // 10 + 1),
pl AS (SELECT license, body, units, w, i, ws FROM (SELECT license, body, units, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tw WHERE len(ws) >= 3) JOIN an USING (license, body, units, w)),
dw AS (SELECT doc_id, ws, p, ws[p] AS w FROM (SELECT doc_id, ws, unnest(list_filter(range(1, len(ws) + 1), lambda p: list_contains(aw, ws[p]))) AS p
  FROM (SELECT doc_id, {TERMS_SQL.format("t")} AS ws FROM f), (SELECT list(DISTINCT w) AS aw FROM an))),
wi AS (SELECT DISTINCT doc_id, license, body, units, dw.ws[p - i + 1:p - i + len(pl.ws)] AS win FROM dw JOIN pl USING (w) WHERE p >= i AND p - i + len(pl.ws) <= len(dw.ws)
  AND len(list_intersect(dw.ws[p - i + 1:p - i + len(pl.ws)], pl.ws)) >= len(list_distinct(pl.ws)) - len(list_distinct(pl.ws)) // 10),
ww AS (SELECT doc_id, license, body, units, win, w, count(*) AS c FROM (SELECT *, unnest(win) AS w FROM wi) GROUP BY ALL),
wn AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id, license, body, units, win)) AS wnorm FROM
  (SELECT doc_id, license, body, units, win, w, c * coalesce(idf, ln(1 + n) + 1) AS x FROM ww LEFT JOIN idf USING (w), n)),
cs AS (SELECT doc_id, whole, license, round(score, 6) AS score FROM (SELECT doc_id, unit, whole, license, sum(un.x * tv.x / norm) / any_value(unorm) AS score
  FROM un JOIN tv USING (w) WHERE units GROUP BY doc_id, unit, whole, license, body UNION ALL
  SELECT doc_id, NULL, false, license, sum(wn.x * tv.x / norm) / any_value(wnorm) FROM wn JOIN tv USING (license, body, units, w) GROUP BY doc_id, win, license, body, units)
  WHERE round(score, 6) >= 0.7),
own AS (SELECT doc_id, min(struct_pack(below := -score, license := license)) AS b, bool_or(whole) AS whole FROM cs GROUP BY doc_id),
held AS (SELECT folder AS above, min(b).license AS license FROM f JOIN own USING (doc_id) WHERE whole OR name = 'NOTICE' GROUP BY folder),
up AS (SELECT folder, k, array_to_string(string_split(folder, '/')[1:k], '/') AS above FROM (SELECT DISTINCT folder FROM f), range(0, 20) AS r(k) WHERE k <= len(string_split(folder, '/'))),
near AS (SELECT folder, arg_max(above, k) AS above, arg_max(license, k) AS license FROM up JOIN held USING (above) GROUP BY folder)
SELECT doc_id, concat(f.folder, '/', name) AS s3_key, b.license AS own_license, -b.below AS score, coalesce(b.license, near.license) AS license,
  CASE WHEN b IS NULL THEN near.above END AS inherited_from FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near ON near.folder = f.folder"""


@query("op1_license_scan", LICENSE_SQL)
def _(spark, folder):
    # a shelf of a hundred documents is a directory, its first document the directory's notice
    shelf = F.format_string("%s/%s/%d", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("doc_id div 100"))
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("NOTICE")).otherwise(F.format_string("%d.txt", "doc_id"))
    images = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.concat(shelf, F.lit("/"), name).alias("s3_key"), F.col("text").alias("exif"))
    return licenses.license_scan(images).withColumnRenamed("id", "doc_id")


# --- 2 ------------------------------------------------------------------------------------------------------------


@query("op2_piece_round_trip")
def _(spark, folder):
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    done = pieces.round_trip_notes(notes(spark, folder), model)
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("notes", F.lit(""))).alias("round_trip"))


# --- 3 ------------------------------------------------------------------------------------------------------------

TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op3_top_descriptors", TOPK_SQL)
def _(spark, folder):
    vecs = table(spark, folder, "embeddings").select(F.col("vec_id").alias("desc_id"), topk.whole_vectors(F.col("embedding")).alias("vec"))
    found = topk.top_descriptors(vecs.where("desc_id % 20 = 0"), vecs, k=20)
    return found.withColumnRenamed("desc_id", "vec_id")


# --- 4 ------------------------------------------------------------------------------------------------------------


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as jobs with error messages."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("error_message"))


@query("op4_secret_spans")
def _(spark, folder):
    jobs = messages(spark, folder)
    model = secrets.character_model(secrets.labelled_samples(jobs))
    found = secrets.secret_spans(jobs, model)

    def of_kind(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(F.col("id").alias("doc_id"), of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
                        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), of_kind(3).alias("n_random"))


# --- 5 ------------------------------------------------------------------------------------------------------------


def fold(column: str, parts: int):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts)), F.lit(0))


@query("op5_score_notes")
def _(spark, folder):
    known = notes(spark, folder).withColumn("trained", fold("id", 10) != 0)
    found = ppm.score_notes(known, across=True)
    return found.select(F.col("id").alias("doc_id"), (fold("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 6 ------------------------------------------------------------------------------------------------------------


@query("op6_notes_language")
def _(spark, folder):
    known = notes(spark, folder)
    labelled = table(spark, folder, "documents").where(fold("doc_id", 4) != 2).select(
        F.col("doc_id").alias("id"), F.col("text").alias("notes"), F.col("lang").alias("language"))
    found = language.notes_language(known, language.fit_language_network(labelled))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), F.col("language").alias("lang_pred"), "score")


# --- 7 ------------------------------------------------------------------------------------------------------------


@query("op7_notes_fingerprints")
def _(spark, folder):
    found = fingerprints.edited_fingerprints(notes(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("print")).alias("fingerprint"),
                        fingerprints.as_text(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


# --- 8 ------------------------------------------------------------------------------------------------------------


@query("op8_near_duplicate_notes")
def _(spark, folder):
    return simhash.near_duplicate_notes(notes(spark, folder), words=3).withColumnRenamed("id", "doc_id")


# --- 9 ------------------------------------------------------------------------------------------------------------


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_pack_notes")
def _(spark, folder):
    return packing.pack_notes(notes(spark, folder), word_tokenizer(), 4096).withColumnRenamed("id", "doc_id")


# --- 10 -----------------------------------------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URL_SQL = """WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES %s),
m AS (SELECT page_id, max_by(struct_pack(rule := rh || rp, v := v), length(rh || rp)) AS b
  FROM (SELECT DISTINCT page_id, host, path FROM h) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id""" % ", ".join(map(str, RULES))


@query("op10_url_filter", URL_SQL)
def _(spark, folder):
    hooks = table(spark, folder, "pages").select(F.col("page_id").alias("id"), "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge_webhooks(hooks, rules).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


# --- 11 -----------------------------------------------------------------------------------------------------------


@query("op11_notes_toxicity")
def _(spark, folder):
    known = notes(spark, folder)
    labels = table(spark, folder, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    labelled = known.where(fold("id", 3) != 1).join(labels, "id", "left")
    found = toxicity.notes_toxicity(known, toxicity.fit_toxicity(labelled))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "score", F.col("toxic").alias("predicted"))


# --- 12 -----------------------------------------------------------------------------------------------------------

AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(doc_id, 9223372036854775807) > coalesce(first, 9223372036854775807) AS INT) AS m FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
x(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, range(1, 6) AS u(step)),
c AS (SELECT part, filter_order, step, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM g, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM c"""


@query("op12_filter_audit", AUDIT_SQL)
def _(spark, folder):
    datasets = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("org_id"), F.col("text").alias("notes"))
    reviews = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"), "toxic")
    return audit.filter_audit(datasets, reviews).withColumnRenamed("org_id", "part")


# --- 13 -----------------------------------------------------------------------------------------------------------

RANKED_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') AS ws FROM documents),
k AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS w FROM benchmark),
t AS (SELECT r, doc_id, size, w, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS size, unnest(ws) AS w FROM d) GROUP BY ALL),
f AS (SELECT w, count(*) AS df FROM t WHERE w IN (SELECT w FROM q) GROUP BY w),
s AS (SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST(50 * size * n AS BIGINT) // CAST(l AS BIGINT))))) AS BIGINT) AS score
  FROM q JOIN t USING (w) JOIN f USING (w), k GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50""".replace("{term}", ranked.TERM)


@query("op13_ranked_search", RANKED_SQL)
def _(spark, folder):
    searches = table(spark, folder, "benchmark").select(F.col("item_id").cast("long").alias("search_id"), F.col("text").alias("search"))
    found = ranked.ranked_datasets(notes(spark, folder), searches, k=50)
    return found.select(F.col("search_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
