"""From raw documents to token ids: toxicity, exact and near duplicates, source mix, byte-pair encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of ``documents``. Null and repeated ids are allowed: every stage decides row by
row. See the operators for other special cases.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import bpe_codec, exact_dedup, minhash_dedup, mixing, toxicity
from emberlog.llm.common import bound_batches, table
from emberlog.session import written

#: 25 bands of 5 values miss a pair at this similarity with a probability of 5e-5
SIMILAR_PERCENT = 80


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones among them, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    bound_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked from a similarity of 0.8 on: the one with the smallest id."""
    bound_batches(spark)
    return minhash_dedup.drop_near_duplicates(docs, percent=SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, from not at all to three times."""
    bound_batches(spark)
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number and digest, and the digest of the text they decode to."""
    bound_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_codec.round_trips(docs, path, keep_ids=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("minhash near-dedup", remove_near_copies),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode),
]

#: a trained network and hashed signatures have no equal in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
