"""A training corpus from raw documents: toxic ones out, copies out, sources mixed, tokens packed.

Each stage works on all that its predecessor kept. `run` writes each stage's result below
the shared folder and reads it again for the next one.

Every stage but the last returns the columns of its input, extra ones included, whatever
their names. A null text counts as empty and is one token, the end id, when packed. Null ids,
languages and sources pass through; rows without a source are a source of their own. Of
repeated rows one stays after exact deduplication. Without labels nothing counts as toxic.
Empty documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forumlake.llm import exact_dedup, mixing, packing, simhash, toxicity
from forumlake.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mix", mixed),
    ("pack", packed),
]

# trained weights, component search and tokenisation are beyond SQL; tests hold it against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
