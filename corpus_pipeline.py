"""From raw documents to packed training sequences: language, toxicity, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and reads
again as the next stage's documents; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.llm import language, mixing, near_dups, packing, toxicity
from tillweave.llm.tables import bounded_batches, id_remainder, written

#: A language predicted with less certainty than this is no decision.
LEAST_CERTAINTY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told: some letters, and a certain enough prediction.

    Null, empty and letterless texts have no language and go; rows that repeat an id are judged one by one.
    """
    bounded_batches(spark)
    return language.keep_known(docs, learn=id_remainder(F.col("doc_id"), 4) != 2, least=LEAST_CERTAINTY)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose windows' compression lengths do not call them toxic; without labels of both kinds all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_ordinary(docs, labels, learn=id_remainder(F.col("doc_id"), 5) != 0)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id; every row is judged by its own text.

    Rows without an id and rows that repeat one take part like others; texts without words are copies of nothing and stay.
    """
    return near_dups.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that sources have their target shares; rows without a source are one of them."""
    return mixing.mixed_documents(docs, weights=(1, 2, 3), share=1.0, cap=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids into sequences of 2048; a document that the mix repeats is packed as often."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), most=2048, end_id=0)


STAGES = [
    ("language", identify_language),
    ("toxicity", remove_toxic),
    ("near_copies", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained classifiers, the tokenizer or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
