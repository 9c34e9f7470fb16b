"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.llm import fingerprints, hosts, language, mixing, near_dups, packing, quality, spelling, token_counts, token_files, toxicity, vector_codes, vector_graphs
from tillweave.llm.encoding import LARGE
from tillweave.llm.tables import bounded_batches, id_remainder, new_path

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{directory}/documents.parquet")


def op1_mixing(spark: SparkSession, directory: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, directory), weights=(1, 2, 3), share=1.0, cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_near_dups(spark: SparkSession, directory: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, directory), width=3, percent=85).drop("class_id")


def op3_token_files(spark: SparkSession, directory: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_token_files(documents(spark, directory), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2, cache=LARGE)
    return token_files.read_documents(spark, folder)


def op4_packing(spark: SparkSession, directory: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(documents(spark, directory), tokenizer, most=2048, end_id=0, cache=LARGE)


def op5_language(spark: SparkSession, directory: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    found = language.predict_language(documents(spark, directory), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, directory), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, directory))


def op8_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality.quality(documents(spark, directory))


#: The rules the contract fixes: verdict, host, path.
RULES = [
    hosts.Rule("allow", "org", "/"),
    hosts.Rule("block", "example.org", "/es/"),
    hosts.Rule("block", "example.org", "/en/1"),
    hosts.Rule("allow", "com", "/fr/"),
    hosts.Rule("block", "com", "/de/"),
]


def op9_hosts(spark: SparkSession, directory: str) -> DataFrame:
    return hosts.judge(spark.read.parquet(f"{directory}/pages.parquet"), RULES)


def op10_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    found = toxicity.score_toxicity(documents(spark, directory), labels, learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def embeddings(spark: SparkSession, directory: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{directory}/embeddings.parquet")


def op11_spelling(spark: SparkSession, directory: str) -> DataFrame:
    return spelling.group_spellings(spelling.count_words(documents(spark, directory), erase_every=97))


def op12_vector_graphs(spark: SparkSession, directory: str) -> DataFrame:
    return vector_graphs.near_vectors(embeddings(spark, directory), least=0.93)


def op13_vector_codes(spark: SparkSession, directory: str) -> DataFrame:
    return vector_codes.vector_codes(embeddings(spark, directory), parts=4, entries=256, rounds=4, scale=1024)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op2_near_dups, op3_token_files, op4_packing, op5_language, op6_token_counts, op7_fingerprints, op8_quality, op9_hosts, op10_toxicity, op11_spelling, op12_vector_graphs, op13_vector_codes)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "sql").glob("*.sql"))}
