"""Queries over whole tables, one for each operator, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bilinear, bpe, content_sort, importance, mixing, pii, simhash, telephony, token_counts, wavelet
from tidemark.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


#: Appended to each document's ids.
END_ID = 2


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return importance.scores(docs, importance.fit(docs, table(spark, sf_dir, "labels")))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_ID))


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_groups(table(spark, sf_dir, "documents"))


def op4_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), radius=3, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), limit=4096)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score(table(spark, sf_dir, "documents"))


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.features(telephony.store(table(spark, sf_dir, "documents")))


def op9_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_importance_resampling": op1_importance_resampling,
        "op2_wavelet_shards": op2_wavelet_shards,
        "op3_content_sort": op3_content_sort,
        "op4_simhash_blocks": op4_simhash_blocks,
        "op5_two_tier_token_counts": op5_two_tier_token_counts,
        "op6_mix_sources": op6_mix_sources,
        "op7_log_bilinear": op7_log_bilinear,
        "op8_telephony_audio": op8_telephony_audio,
        "op9_bpe_segment_tree": op9_bpe_segment_tree,
        "op10_pii_boosting": op10_pii_boosting,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_content_sort": content_sort.ORACLE_SQL,
        "op6_mix_sources": mixing.ORACLE_SQL,
    }
