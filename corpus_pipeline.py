"""From documents to token ids: language, near duplicates, benchmark leaks, personal data, BPE.

Every stage takes and returns COLUMNS; further columns of its input, also of names that a stage uses itself, are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm import bpe_corpus, decontamination, language, pii, simhash
from trivane.llm.workspace import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or with a narrow margin go. A null lang is filled."""
    learned = docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False)))
    judged = language.accepted(language.predict(docs.select(*COLUMNS), language.learn(learned), COLUMNS))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group, once: of several texts of one id the first in order.

    Texts of one group have near fingerprints and a Jaccard similarity of five-word shingles of 0.8 or more, or are linked
    by such texts. Documents without an id are in no group and stay.
    """
    docs = docs.select(*COLUMNS)
    groups = simhash.near_copies(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_copies"))
    groups = materialise(groups.withColumnRenamed("doc_id", "_id"), "kept")
    # one join at every size: texts are dealt once and not sorted, each task holds its part of the ids
    kept = docs.join(groups.hint("shuffle_hash"), docs["doc_id"].cast("long") == groups["_id"])
    if not groups.filter("_copies > 1").isEmpty():
        least = F.min(F.struct("text", *[c for c in COLUMNS if c not in ("doc_id", "text")])).alias("row")
        once = kept.filter("_copies > 1").groupBy("doc_id").agg(least).select("doc_id", "row.*")
        kept = kept.filter("_copies = 1").select(*COLUMNS).unionByName(once)
    return kept.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontamination.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = materialise(found.filter("octet_length(hits) > 0").select(F.col("doc_id").alias("_id")).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    found = pii.find(docs, pii.default_tagger(), [c for c in COLUMNS if c != "text"])
    clean = found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("redacted").cast("long"))
    return clean.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text."""
    kept = [c for c in COLUMNS if c != "text"]
    return bpe_corpus.encode(docs, public_tokenizers.path(VOCABULARY), kept, verify=True).select(*kept, "n_tokens", "ids", "round_trip")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: SQL cannot express a compression classifier, a trained tagger or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
