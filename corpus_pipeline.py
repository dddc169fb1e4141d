"""From raw documents to packed sequences: rules, line dedup, near-dedup, mixing, packing.

Every stage takes what the one before wrote. The rules stage goes by the posterior alone, not by the length and
repetition tests of the rules query, so that clean short documents stay. Mixing takes no document twice and asks for
nine tenths of the tokens, so its weights bind in the sources that have too much of them. Near-duplicates link at a
similarity of 0.8; op6's 0.85 is its query's contract only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from tessera.llm.common import discard, shared_folder
from tessera.llm.queries import MIX_LEVELS, MIX_WEIGHTS


#: Words and stems that a worker remembers for packing; it keeps them while the other stages run beside a JVM that has grown.
REMEMBERED = (200_000, 300_000)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, base=False)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, MIX_LEVELS(), MIX_WEIGHTS, (9, 10), max_epochs=1, seed=7)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Packing, and the rules' expectation-maximisation, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the cluster's shared folder and read again; what the
    stages before it wrote is deleted then. The last stage's input stays, as its rows may be computed from it again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
