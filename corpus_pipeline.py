"""The corpus pipeline: documents to packed training sequences.

STAGES are (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns a
frame, which is written as Parquet and reread as the next one's docs. All but the last return
the columns of documents (whatever columns these have; a stage needs doc_id, text and, for
language ID, lang). Every stage works on all that its predecessor kept:

1. language: drops documents that the language models, learned from the labelled ones, reject.
2. quality: drops documents that the current policy rejects.
3. duplicates: of each group of near duplicates (5-word shingles, a similarity of 0.8 or
   more, linked directly or through others) keeps the one of smallest id.
4. secrets: masks secrets in the texts.
5. packing: cuts and packs the documents into sequences of at most 1024 ids.

Odd input: a null or empty text goes in the first stage (it has no letter); repeated rows are
copies of one document, of which one stays; empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from zonecast.llm import jaccard, langid, packing, quality, secrets
from zonecast.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, words=5, num=4, den=5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("quality", quality_rules),
    ("duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL = None  # SQL can express neither the language models nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the session's shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
