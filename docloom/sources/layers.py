"""Chunks, summaries and other layers of a knowledge base on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.chunking import strip_header, with_header


def save_layer(rows: DataFrame, out: str, layer: str, format: str = "json") -> None:
    """Writes rows (kb_id, ...) to the folder of a layer, parted by kb_id. Written again, the knowledge bases in ``rows``
    replace their own rows and leave others alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").format(format).save(f"{out}/{layer}")


def load_layer(spark: SparkSession, out: str, layer: str, schema: str, format: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(format).load(f"{out}/{layer}")


def save_chunks(chunks: DataFrame, out: str) -> None:
    """Writes chunks (kb_id, doc_id, chunk_id, token_count, content) with a header above each body; chunks that come twice
    are written once."""
    stored = with_header(F.col("chunk_id"), F.col("doc_id").cast("string"), F.col("token_count"), F.col("content"))
    save_layer(chunks.dropDuplicates(["kb_id", "doc_id", "chunk_id"]).select("kb_id", "doc_id", "chunk_id", stored.alias("stored")), out, "l2", "parquet")


def load_chunks(spark: SparkSession, out: str) -> DataFrame:
    """(kb_id, doc_id, chunk_id, content) with the headers taken off."""
    return spark.read.parquet(f"{out}/l2").select("kb_id", "doc_id", "chunk_id", strip_header(F.col("stored")).alias("content"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): text and Markdown files as they are, one row each."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    return d.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
