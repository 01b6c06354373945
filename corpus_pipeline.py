"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import mixing, ngrams, packing, quality, substrings
from weftline.llm.queries import held_out

#: None: SQL can express none of n-gram joins, recompression and packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more; it never learns from held-out labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return quality.score(docs, quality.train(docs, labels), into="_score").where("_score >= 0.7").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return ngrams.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of any 35-word run that stands elsewhere too."""
    return substrings.cleaned(docs, n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents as often as they are taken."""
    return mixing.mixed(docs, n_chars="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 2048."""
    return packing.pack(packing.tokenised(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", keep_good), ("near duplicates", one_of_each), ("repeats", cut_repeats), ("mix", mix_sources), ("pack", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's rows written and read again as the next one's documents."""
    from weftline.llm.store import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
