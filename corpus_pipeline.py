"""Corpus pipeline: documents -> one language known -> near-duplicates gone -> secrets masked -> mixed -> tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
stored as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearline.llm import byte_bpe, language_bits, queries, secret_markov, simhash_index, temperature_mix
from nearline.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``und`` (a null text, or one without a letter) goes.

    The score is a share of known n-grams, not a confidence: clean texts that
    are short, in a rare language or of new words score low, and stay.  Where
    no language was learned, every text with a letter stays.
    """
    model = language_bits.train(docs.where(~queries.held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_bits.predict(docs, model).where("lang_pred <> 'und'").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints within 3 bits: that of least id, then of least text hash.

    Rows without an id come last, but a component of only such rows keeps one too.
    """
    return simhash_index.representatives(docs, shingle=3, distance=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mask and n_chars brought up to date."""
    found = secret_markov.scan(docs, secret_markov.train(docs))
    masked = secret_markov.redact(found).select(*docs.columns)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to twice (one row for each pass)."""
    return temperature_mix.temperature_mix(docs, repeat_limit=2.0).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digest of the bytes that they decode to."""
    out = byte_bpe.encode(docs, queries.vocab_path(), with_decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_scan),
          ("mixing", mixing), ("bpe", bpe_tokens)]
#: The stages rest on trained models, XXH64 fingerprints and byte-pair merges, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
