"""From raw documents to packed training sequences, in stages that each read what the stage before wrote.

Rows that share a doc_id stay or go together; rows with a null doc_id are classified, cut and packed like all others
and are never near copies.  A stage on an empty table gives an empty table; texts are read whole in every stage; ties are those
of the operators.  Columns beyond those of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, minhash, packing, quality
from tidemark.llm.common import release, shared_dir, stashed
from tidemark.llm.queries import table, tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_last: list[str] = []


def _stage(f: Stage) -> Stage:
    """A stage that first deletes what the stage before it stashed: its result has been written by then."""

    @functools.wraps(f)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _last)
        before = set(stashed())
        out = f(spark, docs, sf_dir)
        _last[:] = [p for p in stashed() if p not in before]
        return out

    return staged


@_stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go, and with them documents of which no line is left."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@_stage
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return minhash.keep_one(docs)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: SQL cannot express a fitted classifier, alignment or a tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to shared storage and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    release(spark, _last)
    return docs
