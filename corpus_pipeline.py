"""Pipeline over documents: each stage's result is written as Parquet and read again as the next one's docs.

Stages, in order: documents found toxic go; of equal texts one stays; of near duplicates one stays; a sample is drawn
that meets the target weights of sources, languages and topics; what is left is encoded, and decoded again as a check.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm._store import shared_root
from strandline.llm.bpe import encode_documents
from strandline.llm.cuckoo import drop_exact_duplicates
from strandline.llm.minhash import drop_similar
from strandline.llm.mixing import sample_mixture
from strandline.llm.queries import vocabulary_path
from strandline.llm.toxicity import drop_toxic, train
from strandline.session import table


#: Words that a task of the last stage keeps with their ids; executors come to it with the memory of all stages before.
MEMO_WORDS = 100_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a model fitted on the labelled ones among them doesn't find toxic."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document with the smallest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share at least 0.8 of their five-word shingles, directly or through others, the one with the smallest id."""
    return drop_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the target weights."""
    return sample_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encode_documents(docs, vocabulary_path(), memo_words=MEMO_WORDS)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("encode", encode)]

#: SQL can express neither the fitted model nor the encoder; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them goes to the folder that the executors share."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_root(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
