"""The queries of this package: one opN_<name> for each operator over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op3_mixing, op4_impact_topk, op6_chat
from .op1_pii import pseudonymise
from .op10_html import extract_text
from .op2_language import identify
from .op5_minhash_forest import near_duplicates
from .op7_bpe import digest_texts
from .op8_e8_lattice import near_vectors
from .op9_token_counts import count_tokens
from .staging import read_table


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), found="pii_kinds")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mixing.plan_mix(read_table(spark, sf_dir, "documents"))


def op4_impact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_impact_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_chat.render_chats(read_table(spark, sf_dir, "conversations"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_e8_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an empty cache each time, so that its figures hold the whole work."""
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii_pseudonyms, op2_language_mixture, op3_source_mix, op4_impact_topk_search, op5_minhash_forest, op6_chat_snapshots, op7_bpe_round_trip, op8_e8_lattice_links, op9_token_counts, op10_html_main_text)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": op3_mixing.ORACLE_SQL, "op4_impact_topk_search": op4_impact_topk.ORACLE_SQL, "op6_chat_snapshots": op6_chat.ORACLE_SQL}
