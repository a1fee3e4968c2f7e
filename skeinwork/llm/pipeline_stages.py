"""Stages of the corpus pipeline: each calls one operator on all documents that it gets.

Every stage but the last returns its documents with the columns it got. Empty inputs give empty outputs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op1_pii import pseudonymise
from .op2_language import keep_identified, learn
from .op3_mixing import mix_rows
from .op5_minhash_forest import near_duplicates
from .op7_bpe import encode_texts
from .staging import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of which no learned language makes up half. Learned from labelled rows of docs."""
    return keep_identified(docs, learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near-duplicates; of rows with one doc_id, one, the same each time.

    Documents without a doc_id stay. Texts move once, to meet the list of documents that go.
    """
    found = stage(near_duplicates(docs), "near-duplicates")
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = found.filter("doc_id is not null and not kept").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(name))
    if repeated.limit(1).collect():
        every = F.struct(*[F.col(c) for c in docs.columns])
        several = kept.join(repeated, F.col("doc_id") == F.col(name), "left_semi")
        chosen = several.groupBy("doc_id").agg(F.min_by(every, F.sha2(F.to_json(every), 256)).alias("row")).select("row.*")
        kept = kept.join(repeated, F.col("doc_id") == F.col(name), "left_anti").unionByName(chosen.select(docs.columns))
    return kept


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in place of personal data; n_chars follows the new text."""
    done = pseudonymise(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return done.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's repetition rate asks."""
    return mix_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of each emitted document's whole text."""
    ids = encode_texts(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
