"""Exact token-length histogram whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import checkpointed, slices, small_batches
from docloom.llm.tokens import default_tokenizer, encoder

#: Lengths that share one block of the two-level sums.
BLOCK = 128


def token_lengths(docs: DataFrame, tokenizer: str | None = None, end_tokens: int = 0) -> DataFrame:
    """n_tokens (long) of every row's whole text, ``end_tokens`` added; null text counts as empty."""
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lengths = [len(ids) // 4 + end_tokens for ids in encoder(path).encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct ``n_tokens`` value L, with what a context limit of L tokens means for the whole corpus.

    Columns: length; n_docs of exactly that length; docs_to and tokens_to (documents no longer than L, and their
    tokens); docs_over (longer ones); truncated_tokens (tokens kept if each document is cut at L); lost_tokens (tokens
    cut off); quantile (share of documents no longer than L). A quantile q is the smallest length with quantile >= q;
    between two lengths a < L < b, the truncated total is ``tokens_to(a) + L * docs_over(a)``.

    Texts are encoded once, as the histogram is checkpointed. Only the histogram is ordered, in two levels: sums of blocks
    of lengths, then sums within a block, so that no task sees more than a block's lengths or one row per block. Null
    lengths are left out; no rows give an empty result.
    """
    with small_batches(lengths.sparkSession):
        hist = checkpointed(lengths.where("n_tokens IS NOT NULL").groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")))
    hist = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("bd").over(whole).alias("docs_all"),
        F.sum("bt").over(whole).alias("tokens_all"),
    )
    within = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select("*", F.sum("n_docs").over(within).alias("d"), F.sum("tokens").over(within).alias("t"))
    hist = hist.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.col("docs_before") + F.col("d")).alias("docs_to"),
        (F.col("tokens_before") + F.col("t")).alias("tokens_to"),
        "docs_all",
        "tokens_all",
    )
    over = F.col("docs_all") - F.col("docs_to")
    kept = F.col("tokens_to") + over * F.col("length")
    return hist.select(
        "length",
        "n_docs",
        "docs_to",
        "tokens_to",
        over.alias("docs_over"),
        kept.alias("truncated_tokens"),
        (F.col("tokens_all") - kept).alias("lost_tokens"),
        (F.col("docs_to") / F.col("docs_all")).alias("quantile"),
    )
