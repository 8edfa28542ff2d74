"""The corpus operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm.ann import nearest_neighbours
from quire.llm.common import read
from quire.llm.contextmix import score_documents
from quire.llm.filteraudit import audit_filters
from quire.llm.minhash import near_duplicates
from quire.llm.mixing import mix_to_targets
from quire.llm.oracles import FILTER_AUDIT, NEAR_DUPLICATES, REPEATED_BYTES, VECTOR_CODES, WINDOWS_OF_WORDS
from quire.llm.packing import pack_documents
from quire.llm.pii import pseudonymize
from quire.llm.quality import quality_verdicts
from quire.llm.sharding import shard_documents
from quire.llm.substring import dedup_substrings
from quire.llm.suffix import dedup_bytes
from quire.llm.urlfilter import filter_urls
from quire.llm.vectorcodes import compress_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The other operators' verdicts, draws, plans and digests are beyond SQL; tests/llm compares them with plain Python.
ORACLES = {"op7_substring_dedup": WINDOWS_OF_WORDS, "op8_minhash_near_dedup": NEAR_DUPLICATES, "op9_suffix_dedup": REPEATED_BYTES, "op11_annular_codes": VECTOR_CODES, "op12_filter_audit": FILTER_AUDIT}


def op10_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(read(spark, sf_dir, "documents")).drop("row_key")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), count="n_replaced")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op6_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(read(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op1_mix_sources, op2_pack_sequences, op3_quality_rules, op4_pii_pseudonyms, op5_url_filter, op6_multi_index_search, op7_substring_dedup, op8_minhash_near_dedup, op9_suffix_dedup, op10_shuffle_shards, op11_annular_codes, op12_filter_audit, op13_context_mixing)}
