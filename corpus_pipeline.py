"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last return the columns of
``documents``, others that a caller's table has among them, whatever their names.

Cases, for all stages: a null text counts as empty and a null source is a source of its own; empty texts are one group of equal
texts; texts of any length are whole; repeated rows are rows of one group, of which one stays; a null doc_id stays in a group only
where it is the one to stay by its stage's order; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, content_sort, importance, mixing, simhash
from tidemark.llm.common import table, written

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose importance key is among the k largest. Ties stay or go together; without labels of both kinds all stay."""
    return importance.keep_good(docs, importance.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the smallest doc_id, null last."""
    return content_sort.drop_duplicates_by_content(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by pairs at a similarity of 0.8 or more on shingles of five words: the
    smallest doc_id, null last. Texts without words are one group."""
    return simhash.drop_near_duplicates(docs, shingle=5)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, documents repeated by epochs; one without words gives no row. Ties of key go by
    doc_id."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of each row's ids and of what they decode to; one row for each."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: The stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-").lower())
    return docs
