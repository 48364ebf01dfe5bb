"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Every stage but the last takes documents and returns those that stay, with the columns they came with; the quality rules
take boilerplate lines out of their texts. Part of the subpackage ``docloom.llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.base import checkpoint_folder, removed, table
from docloom.llm.decontaminate import decontaminated
from docloom.llm.language_id import identified
from docloom.llm.line_quality import cleaned
from docloom.llm.packing import pack
from docloom.llm.simhash import one_of_each


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cleaned(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, memo_words=150_000)  # workers still hold what earlier stages left in them


STAGES = [
    ("language_id", recognise_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The language models, the fingerprints and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written as Parquet below the checkpoint folder and read again.

    A stage's folder is removed once the next stage has done with it: the last one holds what it needs in checkpoints.
    """
    folder = f"{checkpoint_folder(spark)}/pipeline_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs.write.parquet(f"{folder}/{i}_{name}")
                docs = spark.read.parquet(f"{folder}/{i}_{name}")
            if i:
                removed(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    finally:
        removed(spark, folder)
    return docs
