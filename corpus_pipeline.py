"""Corpus pipeline: toxicity, language, near duplicates, benchmark passages, then BPE ids.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the
columns of ``docs``, whatever their names. Nulls in any column, empty and very long texts, repeated rows and ids, and
an empty table are allowed in every stage, with the results that each states. No stage is expressible in SQL as a whole
(learned filters, hashed links), so ORACLE_SQL is None and the tests count the rows again by brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, decontaminate, langid, neardup, toxicity
from pathloom.llm.queries import tokenizer_path
from pathloom.llm.workspace import discard, fresh_path, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts score as clean and stay; repeated rows go or stay alike.

    An empty table stays empty; the lexicon is then the fixed seed.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or hardly like any learned language, go.

    Repeated rows go or stay alike. Without any labelled row every text with a letter stays.
    """
    return langid.with_language(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (0.8 of five-word shingles) stays.

    Rows that share an id stay or go together, whatever their texts; null ids stay, as do null and empty texts, which
    are near nothing.
    """
    gone = neardup.near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 of its five-word shingles) go; null and empty texts stay.

    Without items all stay.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row's whole text.

    A null or empty text has no ids and the digests of nothing; a null id is kept, a repeated row is encoded again.
    """
    return bpe.round_trips(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; only the last one's input is kept."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}", path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
