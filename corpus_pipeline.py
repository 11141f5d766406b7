"""From raw documents to packed training sequences: each stage is one operator of ``gleaner.llm``.

A stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns documents; the last returns packed
pieces. Between stages the rows are written as Parquet and read again, in the shared checkpoint folder, from which the
caller clears them once the result is written.

Every stage decides row by row, by the row's text: null and empty texts count as the empty text, rows without an id and
rows that share one are no exception, rows equal in id and text are one row after the near-duplicate stage, columns
beyond those of documents are carried along up to the last stage, whose rows are pieces, and an empty table gives an
empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontam, packing, quality, similar
from gleaner.llm.common import checkpoint_folder, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, trained on labelled documents of ``sf_dir``, rejects go."""
    return quality.keep_good(docs, quality.fitted(spark, sf_dir))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays (five words, Jaccard of 0.8 or more, verified): candidates from
    SimHash balls and, for what lies beyond their radius, from bands of minimum hashes."""
    return similar.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized, cut and packed: one row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained network and tokenizers are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
