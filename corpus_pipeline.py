"""The corpus pipeline: documents in, packed training sequences out.

Language identification drops documents without a recognisable language, SimHash near-dedup keeps one document of
each group of near-duplicates, the secret scan redacts what it finds, and best-fit packing lays the rest out in
sequences.  ``run`` writes every stage as Parquet under the folder of ``spark.checkpoint.dir`` and reads it again for the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.llm import language, packing, secrets, simhash
from swathline.llm.common import fresh
from swathline.llm.queries import fold, word_tokenizer
from swathline.session import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and is in one of the learned languages; all columns stay.

    The network names the nearest language; a text with fewer known trigrams than that language's learned windows have goes
    (``known_trigrams``: foreign languages, gibberish).
    The network learns from labelled documents of this stage's own input, held-out ones (see ``op6_``) left out.  Null and
    letterless texts go.  With no labelled document nothing can be recognised, and every document goes.
    """
    labelled = docs.where(fold("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), F.col("text").alias("notes"), F.col("lang").alias("language"))
    rows = language.learned_windows(labelled)
    net, known = language.network_of(rows), language.known_trigrams(rows)
    name = fresh(docs, "_language")
    found = docs.withColumn(name, language.language_udf(net, known=known)("text"))
    return found.where(F.col(f"{name}.language") != language.UNKNOWN).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the one with the smallest doc_id."""
    return as_documents(docs, "text", "notes", lambda notes: simhash.one_of_each(notes, words=5, similarity=0.8))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by ``[secret]``; ``n_chars`` follows where a text has changed."""
    def work(jobs: DataFrame) -> DataFrame:
        model = secrets.character_model(secrets.labelled_samples(jobs.select("id", "error_message")))
        return secrets.redact(jobs, model)

    old = fresh(docs, "_old")
    clean = as_documents(docs.withColumn(old, F.length("text")), "text", "error_message", work)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col(old) != F.length("text"), size).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    datasets = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("notes"))
    return packing.pack_notes(datasets, word_tokenizer(), 4096).withColumnRenamed("id", "doc_id")


def as_documents(docs: DataFrame, text: str, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on documents whose doc_id and text are called id and ``name``; columns that already have such a name step aside."""
    aside = {c: fresh(docs, f"_aside_{c}") for c in docs.columns if c.lower() in ("id", name)}
    done = work(docs.withColumnsRenamed(aside).withColumnsRenamed({"doc_id": "id", text: name}))
    named = done.withColumnsRenamed({"id": "doc_id", name: text})
    return named.withColumnsRenamed({new: old for old, new in aside.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: A trained network and SimHash balls have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
