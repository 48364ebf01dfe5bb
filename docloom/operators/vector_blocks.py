"""Exact nearest vectors from a written table of clusters, of which most are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.vectors import best_of_batches, matrix

#: A block is left out only if its best possible score is below the k-th by more than this; scores are compared to 9 digits.
MARGIN = 1e-6


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of zeros stay."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _centres(sample: np.ndarray, blocks: int, rounds: int = 5) -> np.ndarray:
    """Some rounds of k-means on a sample; the first rows begin. Centres that lose all their rows stay where they are."""
    c = sample[: max(1, min(blocks, len(sample) // 4))].copy()
    for _ in range(rounds):
        at = (sample @ c.T - (c * c).sum(1) / 2).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        n = np.bincount(at, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def write_blocks(vectors: DataFrame, folder: str, key: str = "vec_id", embedding: str = "embedding", blocks: int = 256, sample: int = 8192) -> None:
    """Writes ``folder/vectors`` (key, embedding, distance; partitioned by block) and ``folder/blocks`` (block, centre,
    radius, n).

    Every row that has a vector is written, in the block whose centre is the nearest to its vector scaled to length 1.
    Centres, ``blocks`` at most, are fitted on the ``sample`` rows with the smallest hashes of their keys, which is all
    that the driver sees and bounds only how well blocks are shaped, not what is found. Rows are dealt by ranges of block
    and hash, so a block that holds a third of all rows is written by many tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(key, embedding).where(F.col(embedding).isNotNull())
    first = [r[0] for r in rows.orderBy(F.xxhash64(key), key).limit(sample).select(embedding).collect()]
    centres = _centres(_scaled(np.array(first, np.float64)), blocks) if first else np.zeros((1, 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _scaled(matrix(batch.column(1), centres.shape[1]))
            at = (v @ centres.T - (centres * centres).sum(1) / 2).argmax(1) if len(v) else np.zeros(0, np.int64)
            distance = np.linalg.norm(v - centres[at], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance), pa.array(at.astype(np.int32))], [key, embedding, "distance", "block"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(placed, f"`{key}` {kinds[key]}, `{embedding}` {kinds[embedding]}, distance double, block int")
    out.repartitionByRange(F.col("block"), F.xxhash64(key)).write.partitionBy("block").parquet(f"{folder}/vectors")
    written = spark.read.schema(out.schema).parquet(f"{folder}/vectors")
    where = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "block int, centre array<double>")
    radii = written.groupBy("block").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
    where.join(F.broadcast(radii), "block").coalesce(1).write.parquet(f"{folder}/blocks")  # a row for each block


def nearest_in_blocks(spark: SparkSession, folder: str, query: list[float], k: int, key: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, dict[str, int]]:
    """(key, score) of the k rows with the largest cosine to the query, ties by key, as ``vectors.nearest`` finds them; and how
    many blocks and rows there are and were read.

    For vectors of length 1, cosine is 1 - d^2 / 2, and a block's rows are no nearer than d(query, centre) - radius. The
    most promising blocks that hold k rows are read first; their k-th score tells which of the others may hold a better
    row or one that ties, and only those are read. A vector of zeros scores 0, which is below what its distance would give,
    so bounds hold for it too. An empty table gives no rows.
    """
    info = spark.read.parquet(f"{folder}/blocks").orderBy("block").collect()  # as many rows as write_blocks was allowed
    vectors = spark.read.parquet(f"{folder}/vectors") if info else None
    report = {"blocks": len(info), "blocks_read": 0, "rows": sum(r["n"] for r in info), "rows_read": 0}
    q = np.asarray(query, np.float64)
    q = q / max(np.linalg.norm(q), 1e-300)
    if not info:
        return spark.createDataFrame([], "vec_id long, score double").withColumnRenamed("vec_id", key), report
    gap = np.maximum(np.linalg.norm(np.array([r["centre"] for r in info]) - q, axis=1) - np.array([r["radius"] for r in info]), 0)
    most = 1 - gap**2 / 2
    order = np.argsort(-most, kind="stable")
    held = np.cumsum([info[i]["n"] for i in order])
    wave = order[: int(np.searchsorted(held, k)) + 1]

    def best(chosen: np.ndarray) -> DataFrame:
        report["blocks_read"] += len(chosen)
        report["rows_read"] += sum(info[i]["n"] for i in chosen)
        part = vectors.where(F.col("block").isin([info[i]["block"] for i in chosen]))
        return best_of_batches(part, query, k, key, embedding)

    found = best(wave)
    top = found.collect()  # k rows
    limit = top[-1]["score"] - MARGIN if len(top) == k else -np.inf
    rest = np.array([i for i in order[len(wave) :] if most[i] >= limit], np.int64)
    out = spark.createDataFrame(top, found.schema)
    if len(rest):
        out = out.unionByName(best(rest)).orderBy(F.desc(F.round("score", 9)), key).limit(k)
    return out, report
