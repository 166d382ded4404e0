"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each stage's rows into the shared scratch folder and reads them for the next.

Defined results, in every stage: a null text counts as an empty one (and has no
language, so the first stage rejects it); of rows that share an id, each is judged
in the first stage, and the second keeps one, that with the first text in order;
rows without an id leave in the second stage; equal texts are near duplicates, of
which the smallest id stays; an empty table gives no rows; columns beyond those of
`documents` are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrain.llm import decontamination, language_id, ngram_join, packing, suffix_dedup
from cellgrain.llm.common import bucket_of, free_shuffles, read, stash
from cellgrain.llm.queries import vocabulary


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told; texts without a letter, and texts unlike every profile, go. Only texts and labels of `docs` are learnt from."""
    profiles = language_id.fit_profiles(docs, bucket_of("doc_id", 5) != 0)
    return language_id.keep_identified(docs, profiles)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the 5-word-shingle Jaccard graph (0.75)."""
    return ngram_join.keep_representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 50-byte strings that also start in a document with a smaller id."""
    return suffix_dedup.without_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids, each source at its share."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Tokenizers and tiling have no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
