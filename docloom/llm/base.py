"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows have been counted and are no more than this.
BROADCAST_ROWS = 200_000

#: Words of the scanning operators: runs of digits, a-z and anything beyond ASCII, after A-Z are lower-cased.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The five control characters and the blank that part words elsewhere.
BLANK = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one on a local master (tests);
    elsewhere an error, as executors could not share such a folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own below the checkpoint folder, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``most`` rows; otherwise as it is, for a shuffled join.

    ``df`` should be cheap to count: checkpointed or derived from a small table.
    """
    return F.broadcast(df) if is_small(df, most) else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside: rows here are whole texts. The caller's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``, run at once in small batches and checkpointed, so that no text is mapped twice."""
    with small_batches(df.sparkSession):
        return checkpointed(df.mapInArrow(run, schema))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller pieces, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; whole ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column, separators: str = NON_WORD) -> Column:
    """Words of ``text``, null counting as empty; ``separators`` is a pattern of what stands between words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def count_words(text: Column, separators: str = NON_WORD) -> Column:
    """How many words ``words_of`` would give; only the first and last part of a split can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    empty_last = F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
    return (F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - empty_last).cast("long")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that tell rows apart: the id and a hash of the text. Equal rows share a key and so a result."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_hash")]


def on_key(left: DataFrame, right: DataFrame):
    """Null-safe equality on the columns of ``row_key``."""
    return left["_id"].eqNullSafe(right["_id"]) & (left["_hash"] == right["_hash"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose key is not in ``gone`` (columns of ``row_key``); columns as they came.

    Names used on the way differ from all of the documents' own.
    """
    mark = "_key"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    keyed = docs.withColumns({f"{mark}id": F.col("doc_id"), f"{mark}hash": F.xxhash64("text")})
    gone = small_or_shuffled(checkpointed(gone.select(F.col("_id").alias(f"{mark}gone_id"), F.col("_hash").alias(f"{mark}gone_hash")).distinct()))
    same = F.col(f"{mark}id").eqNullSafe(F.col(f"{mark}gone_id")) & (F.col(f"{mark}hash") == F.col(f"{mark}gone_hash"))
    return keyed.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
