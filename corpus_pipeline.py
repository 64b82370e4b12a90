"""A training corpus from raw documents: quality rules, line dedup, near duplicates, decontamination, encoding.

Defined results: a null or blank text fails the base rules of the first stage; a null doc_id counts as later than any
other where one of a group of copies stays, and is kept; of rows that share both doc_id and text one stays; other columns
pass through all stages but the last, whatever their names; an empty table of documents gives no rows, empty labels no
verdict beyond the base rules, and an empty benchmark no leaks. Each stage is defined for all inputs, not just for what
its predecessor leaves: see the operators.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.llm import bpe, decontaminate, jaccard, line_dedup, quality_rules
from lingora.llm.common import checkpoint_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees."""
    forest = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, forest)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source."""
    return line_dedup.drop_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of similar ones."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256)."""
    out = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontaminate", decontamination), ("byte_bpe", tokens)]

#: Trees and edit distances have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder, and its predecessor's files go.

    The files that the returned rows are read from go when the session's file system is closed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = None
    for name, stage in STAGES[:-1]:
        at = f"{home}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            files.delete(path(before), True)
        before = at
    files.deleteOnExit(path(home))
    return STAGES[-1][1](spark, docs, sf_dir)
