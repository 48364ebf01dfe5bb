"""Token ids on disk: one zstandard frame per document, a shared dictionary, and an offset index."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.base import checkpoint_folder, checkpointed, removed, slices, small_batches, small_or_shuffled
from docloom.llm.tokens import default_tokenizer, encoder

#: The dictionary is trained on at most so many documents, those with the smallest hashes, and the first ids of each. It
#: decides how well documents compress, never what is stored.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 1000, 4096, 64 << 10, 1
#: A block of the data file closes after so many documents or compressed bytes.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
#: Documents of one shard at most, on average.
SHARD_DOCS = 20_000

BLOCKS = (
    "shard long, block long, first_id long, last_id long, n_docs long, n_tokens long, dictionary string, width int, "
    "ids array<long>, counts array<long>, offsets array<long>, data binary"
)


def _packed(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, path: str, width: int, n_docs: int) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample; empty if the sample is too small for one."""
    import zstandard

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [x[: 4 * SAMPLE_IDS] for x in encoder(path).encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["draw", "ids"])

    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    near = docs.select(draw.alias("draw"), "text").where(F.col("draw") <= 2 * SAMPLE_DOCS / max(1, n_docs))
    rows = near.mapInArrow(encode, "draw double, ids binary").distinct().orderBy("draw").limit(SAMPLE_DOCS).collect()
    samples = [_packed(bytes(r["ids"]), width) for r in rows if r["ids"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_store(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 0) -> str:
    """Writes the ids of every row's whole text, then ``end_id``, in ascending order of doc_id, to the folder ``out``.

    The format has three tables. ``dictionary``: hash and bytes. ``blocks``: each row holds up to 512 documents, every
    one a zstandard frame of its own made with the shared dictionary; ``data`` is the frames end to end, ``offsets``
    where each begins, ``ids`` and ``counts`` the documents and their numbers of ids, ``dictionary`` the hash of the
    one needed, ``width`` the bytes of an id (2 below 65,536 entries, else 4). ``shards``: for each shard, how many ids
    all shards before it hold. A reader finds a document by the blocks' ``first_id`` and ``last_id``, which Parquet
    keeps statistics of, and opens its frame alone.

    Null text is written as the end id alone; null ids come first; equal ids follow one another, ordered by their
    text's hash; rows equal in both are spread over shards by their place in the input. Every write goes through Spark's
    committer, so a lost executor's blocks are written again.
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = 2 if encoder(path).tokenizer.get_vocab_size() <= 65_536 else 4
    n_docs = docs.count()
    dictionary = train_dictionary(docs, path, width, n_docs)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, data binary").write.parquet(f"{out}/dictionary")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // SHARD_DOCS + 1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        schema = pa.schema(
            [(n, pa.int64()) for n in ("shard", "block", "first_id", "last_id", "n_docs", "n_tokens")]
            + [("dictionary", pa.string()), ("width", pa.int32())]
            + [(n, pa.list_(pa.int64())) for n in ("ids", "counts", "offsets")]
            + [("data", pa.binary())]
        )
        state = {"block": 0, "ids": [], "counts": [], "frames": [], "bytes": 0, "shard": None}

        def close() -> pa.RecordBatch:
            ids, counts, frames = state["ids"], state["counts"], state["frames"]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])[:-1]]).astype(int).tolist()
            known = [i for i in ids if i is not None]
            row = {"shard": state["shard"], "block": state["block"], "first_id": min(known, default=None), "last_id": max(known, default=None), "n_docs": len(ids), "n_tokens": sum(counts), "dictionary": digest, "width": width, "ids": ids, "counts": counts, "offsets": offsets, "data": b"".join(frames)}
            state.update(block=state["block"] + 1, ids=[], counts=[], frames=[], bytes=0)
            return pa.RecordBatch.from_pylist([row], schema)

        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            for doc_id, shard, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoder(path).encode(batch.column(1).to_pylist()), strict=True):
                frame = compress(_packed(ids + end, width))
                state["shard"] = shard
                state["ids"].append(doc_id)
                state["counts"].append(len(ids) // 4 + 1)
                state["frames"].append(frame)
                state["bytes"] += len(frame)
                if len(state["ids"]) >= BLOCK_DOCS or state["bytes"] >= BLOCK_BYTES:
                    yield close()
        if state["ids"]:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("place")]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = ordered.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard"))
    with small_batches(spark):
        ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    totals = spark.read.parquet(f"{out}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard of about 64 MB
    totals.select("shard", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")).write.parquet(f"{out}/shards")
    return out


def read_token_store(spark: SparkSession, out: str, doc_ids: list[int] | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the stored documents, or of some: ids as little-endian unsigned 32-bit bytes.

    With ``digest``, ids_crc32 comes instead of the ids, which then stay in the worker.

    ``start`` counts the ids of all documents before. With ``doc_ids``, blocks that can't hold them are skipped by
    their statistics and only the frames asked for are opened.
    """
    blocks = spark.read.parquet(f"{out}/blocks")
    if doc_ids is not None:
        lo, hi = min(doc_ids, default=0), max(doc_ids, default=-1)
        blocks = blocks.where((F.col("last_id") >= lo) & (F.col("first_id") <= hi))
    dictionaries = {r["hash"]: bytes(r["data"]) for r in spark.read.parquet(f"{out}/dictionary").collect()}
    wanted = None if doc_ids is None else set(doc_ids)
    names = ("long", "ids_crc32") if digest else ("binary", "ids")
    heads = spark.read.parquet(f"{out}/blocks").select("shard", "block", "n_tokens")
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("shard", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("before"))
    starts = checkpointed(heads.join(spark.read.parquet(f"{out}/shards").select("shard", F.col("start").alias("base")), "shard").select("shard", "block", (F.col("base") + F.col("before")).alias("start")))
    blocks = blocks.join(small_or_shuffled(starts), ["shard", "block"])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        openers = {h: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None) for h, d in dictionaries.items()}
        for batch in slices(batches, 8):
            for row in batch.to_pylist():
                data, ends = row["data"], [*row["offsets"][1:], len(row["data"])]
                at = (row["start"] + np.concatenate([[0], np.cumsum(row["counts"])[:-1]])).astype(int).tolist()
                out = [
                    (i, s, n, openers[row["dictionary"]].decompress(data[a:b]))
                    for i, s, n, a, b in zip(row["ids"], at, row["counts"], row["offsets"], ends, strict=True)
                    if wanted is None or i in wanted
                ]
                kept = [x[3] if row["width"] == 4 else np.frombuffer(x[3], "<u2").astype("<u4").tobytes() for x in out]
                last = pa.array(map(zlib.crc32, kept), pa.int64()) if digest else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), last], ["doc_id", "start", "n_tokens", names[-1]])

    read = blocks.select("start", "dictionary", "width", "ids", "counts", "offsets", "data")
    return read.mapInArrow(frames, f"doc_id long, start long, n_tokens long, {names[-1]} {names[0]}")


def stored_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes a store below the session's checkpoint folder, reads it back and returns (doc_id, start, n_tokens, ids_crc32).

    The store is removed once it has been read.
    """
    spark = docs.sparkSession
    out = f"{checkpoint_folder(spark)}/token_store_{uuid.uuid4().hex}"
    try:
        write_token_store(docs, out, tokenizer, end_id)
        with small_batches(spark, 32):  # rows are blocks
            return checkpointed(read_token_store(spark, out, digest=True))
    finally:
        removed(spark, out)
