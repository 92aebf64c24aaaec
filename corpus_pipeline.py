"""A training corpus from raw documents: five stages, each an operator of ``newsweft.llm``, each over all rows of the one before."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from newsweft.llm.alignment import benchmark_copies  # noqa: E402
from newsweft.llm.packing import pack  # noqa: E402
from newsweft.llm.repetition import keep_clean  # noqa: E402
from newsweft.llm.substring import substring_dedup  # noqa: E402
from newsweft.llm.weighted import near_duplicates  # noqa: E402
from newsweft.session import ensure_checkpoint_dir  # noqa: E402

#: Columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def of_documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(c for c in docs.columns if c in COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return keep_clean(of_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class, once. One without an id stays unless its class has an id."""
    first = near_duplicates(docs).where("doc_id <=> class_id").select(F.col("doc_id").alias("first_id")).distinct()
    docs = of_documents(docs)
    return docs.join(first, docs.doc_id.eqNullSafe(first.first_id), "left_semi").dropDuplicates(["doc_id", "text"])


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages, else as they were; documents of which no word is left go."""
    docs = of_documents(docs)
    found = substring_dedup(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")], layout=True)
    found = found.withColumns({"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")})
    return found.where("n_removed < n_words").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item. One without an id can't be told and stays."""
    copies = benchmark_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return of_documents(docs).join(copies, "doc_id", "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality), ("MinHash near-dedup", near_dedup), ("substring dedup", substring),
    ("benchmark decontamination", decontaminate), ("packing", packing),
]

#: SQL has no weighted sampling, alignment or tokenizer; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
