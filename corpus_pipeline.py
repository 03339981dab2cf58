"""The corpus pipeline: language, exact copies, near copies, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents``, whatever further ones there are.

Defined cases, stage by stage. A null text: goes in language ID (as do empty ones and
all without a letter), is empty everywhere else. Null or repeated ids: every stage decides about an
id and its text, so other texts of the same id stay; of equal texts in exact
dedup the largest id stays, and rows that share it stay together (so do rows without an id
where no equal text has one); in near dedup the smallest id of a group stays, and rows without
an id always. Very long texts are read whole in every stage. Without any language
label only letterless texts go. An empty table passes every stage and packs into no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almacen.llm import exact_dedup, jaccard, language, packing, queries, secrets
from almacen.llm.common import staged, text_digest, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letters, or a calibrated score near a blind guess."""
    return language.reject_unknown(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest ``doc_id`` of equal texts."""
    return without(docs, exact_dedup.exact_dedup(docs).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest ``doc_id`` of each group of texts linked by five-word shingles, 0.8 or more alike."""
    digests = docs.select("doc_id", "text", text_digest(F.col("text")).alias("text_sha256"))
    found = jaccard.jaccard_components(digests, n=5, percent=80, carry=["text_sha256"])
    return without(docs, found.filter("doc_id <> component_id"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every found secret, at whatever layer, by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("secret_scan", redact_secrets), ("packing", pack)]

#: Language scores, decoded layers and BPE ids are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return staged(STAGES[-1][1](spark, docs, sf_dir), "pipeline-result")
