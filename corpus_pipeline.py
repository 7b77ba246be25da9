"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.llm import bpe, decontam, lines, quality, simhash
from vecatlas.llm.queries import TOKENIZER
from vecatlas.llm.tables import chunk_tables, documents, drop_chunks
from vecatlas.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and both histograms accept."""
    judged, names = quality.judge(docs)
    return judged.where(F.col(names["kept"])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand in ten documents or more."""
    return lines.keep_bitmaps(docs, min_docs=10, min_chars=1, apply=True)[0].select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more)."""
    return simhash.without_near_copies(docs, shingle=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word for word or with other numbers and names."""
    return decontam.without_items(docs, documents(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids."""
    return bpe.with_tokens(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)[0]


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = chunk_tables(spark)
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_chunks(spark, chunk_tables(spark) - before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Distances over learned references, fingerprints and tokens are beyond SQL; tests use brute force.
ORACLE_SQL = None
