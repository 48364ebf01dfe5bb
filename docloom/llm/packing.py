"""Packing documents into windows of tokens: length combinations solved by non-negative least squares."""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import arrow_mapped, checkpointed, slices, small_or_shuffled
from docloom.llm.tokens import MEMO_WORDS, default_tokenizer, encoder

WINDOW, END_ID = 2048, 1
#: Lengths are binned in steps of so many ids; a combination has at most DEPTH pieces.
QUANTUM, DEPTH = 8, 3
#: Pieces are cut at multiples of so many ids, for each of which a checksum is kept.
SEGMENT = 32


def combinations_filling(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All non-decreasing tuples of up to ``depth`` bin sizes that add up to ``bins``."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], rest: int) -> None:
        low = head[-1] if head else 1
        if rest >= low:
            out.append((*head, rest))
        if len(head) + 2 <= depth:
            for b in range(low, rest // 2 + 1):
                extend((*head, b), rest - b)

    extend((), bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least ||a x - b||, by the active-set method of Lawson and Hanson.

    Warns if it has not come to an end after so many rounds; what it returns is then still not negative, but not the least.
    """
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gain = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(gain).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            z = np.zeros_like(x)
            own = a[:, active]
            z[active] = np.linalg.solve(own.T @ own + 1e-9 * np.eye(own.shape[1]), own.T @ b)
            low = active & (z <= 0)
            if not low.any():
                x = z
                break
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], bins: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, how often) that uses no more of any bin than the histogram has.

    Repeat counts solve the least squares problem against the histogram, are rounded to the nearest integer, and are
    lowered where the rounding asks for more than there is.
    """
    held = np.zeros(bins + 1)
    for b, n in histogram.items():
        held[b] = n
    tuples = [t for t in combinations_filling(bins, depth) if all(held[b] >= t.count(b) for b in t)]
    if not tuples:
        return []
    a = np.zeros((bins + 1, len(tuples)))
    for j, t in enumerate(tuples):
        for b in t:
            a[b, j] += 1
    x = np.rint(nnls(a, held)).astype(int)
    out = []
    for j in np.argsort(-x, kind="stable"):
        t = tuples[j]
        n = min(int(x[j]), *(int(held[b]) // t.count(b) for b in t))
        if n > 0:
            out.append((t, n))
            for b in t:
                held[b] -= n
    return out


def joined_crc(crcs: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings end to end, from the CRC-32 and length of each."""
    total = 0
    for crc, n in crcs:
        zeros = bytes(n)
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc  # what n more bytes make of a checksum is linear
    return total


def encoded_pieces(docs: DataFrame, path: str, window: int, end_id: int, memo_words: int = MEMO_WORDS) -> DataFrame:
    """A row for each document: doc_id, doc_tokens, CRC-32 of each full window, length and CRC-32 of the rest, and the
    CRC-32 of the rest's segments as unsigned 32-bit integers; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            counts, full, rests, rest_crcs, segments = [], [], [], [], []
            for ids in encoder(path, memo_words).encode(batch.column(1).to_pylist()):
                ids += end
                n = len(ids) // 4
                cut = n // window * window * 4
                rest = ids[cut:]
                counts.append(n)
                full.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, cut, 4 * window)])
                rests.append(len(rest) // 4)
                rest_crcs.append(zlib.crc32(rest))
                segments.append(np.array([zlib.crc32(rest[i : i + 4 * SEGMENT]) for i in range(0, len(rest), 4 * SEGMENT)], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rests, pa.int64()), pa.array(rest_crcs, pa.int64()), pa.array(segments, pa.binary())],
                ["doc_id", "doc_tokens", "full", "rest", "rest_crc", "segments"],
            )

    return arrow_mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, doc_tokens long, full array<long>, rest long, rest_crc long, segments binary")


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of rests that end where a sequence does, with their checksums."""
    for batch in slices(batches):
        rows = []
        for r in batch.to_pylist():
            crcs = np.frombuffer(r["segments"], "<u4").tolist()
            lengths = [min(SEGMENT, r["rest"] - i * SEGMENT) for i in range(len(crcs))]
            at, done = r["first"], 0
            while done < len(crcs):
                take = min(len(crcs) - done, r["slots"] - at % r["slots"])
                part = list(zip(crcs[done : done + take], (4 * n for n in lengths[done : done + take]), strict=True))
                rows.append((r["rid"], r["doc_id"], r["doc_tokens"], r["begin"] + done * SEGMENT, sum(n for _, n in part) // 4, joined_crc(part), at // r["slots"], at))
                at, done = at + take, done + take
        names = ["rid", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence", "slot"]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(len(names))], names)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Pieces of all documents, each with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: none) and ``end_id``. Full windows are sequences of their own. What
    is left of each document goes into a bin of lengths rounded up to QUANTUM. The bins' histogram, the only thing the
    driver sees, is at most window / QUANTUM numbers; combinations of up to DEPTH bins that fill a window are solved
    against it by non-negative least squares, and a piece's rank in its bin tells which repeat of which combination it
    belongs to. Pieces that the rounded solution leaves over are packed greedily end to end and cut at window
    borders, so only the last sequence has more than rounding for padding.

    ``memo_words`` bounds what a worker keeps of encoded words; fewer take less memory and more time.

    Ranks and running sums come from counts for each partition of a checkpoint, whose partitions do not change, and
    from windows within a partition, so no bin or sequence is gathered. Repeated rows are packed as often as they come;
    null ids stay null; no rows give no pieces.
    """
    path = tokenizer or default_tokenizer()
    bins, slots = window // QUANTUM, window // SEGMENT
    base = encoded_pieces(docs, path, window, end_id, memo_words).select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("rid"))
    rests = base.where("rest > 0").withColumn("bin", F.ceil(F.col("rest") / QUANTUM))
    sizes = checkpointed(rests.groupBy("pid", "bin").agg(F.count("*").alias("n")))
    histogram = {r["bin"]: r["n"] for r in sizes.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    chosen = plan(histogram, bins)

    # full windows
    wholes = checkpointed(base.groupBy("pid").agg(F.sum(F.size("full")).alias("n")))  # a row for each partition
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    at = wholes.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("pid").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    full = base.where(F.size("full") > 0).select("pid", "rid", "doc_id", "doc_tokens", "full").withColumn("up_to", F.coalesce(F.sum(F.size("full")).over(inside), F.lit(0)))
    full = full.join(small_or_shuffled(checkpointed(at)), "pid").select("doc_id", "doc_tokens", (F.col("first") + F.col("up_to")).alias("first"), F.posexplode("full").alias("i", "ids_crc32"))
    full = full.select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    total_full = wholes.agg(F.sum("n")).first()[0] or 0

    # rests, by their rank in their bin
    earlier = Window.partitionBy("bin").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("pid", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("pid", "bin").orderBy("rid")) - 1
    ranked = rests.drop("full").withColumn("own", rank).join(small_or_shuffled(checkpointed(offsets)), ["pid", "bin"]).withColumn("rank", F.col("own") + F.col("earlier"))
    used: dict[int, int] = {}
    intervals, sequence = [], 0
    for combination, n in chosen:
        slot = 0
        for b in sorted(set(combination)):
            m = combination.count(b)
            low = used.get(b, 0)
            intervals.append((b, low, low + m * n, m, sequence, slot))
            used[b] = low + m * n
            slot += m
        sequence += n
    # at most DEPTH rows for each of as many combinations as there are bins: a bound set by the window
    known = F.broadcast(docs.sparkSession.createDataFrame(intervals, "bin long, low long, high long, m long, sequence long, slot long"))
    spare = docs.sparkSession.createDataFrame([(b, used.get(b, 0)) for b in range(1, bins + 1)], "bin long, used long")
    ranked = checkpointed(ranked.select("pid", "rid", "doc_id", "doc_tokens", "rest", "rest_crc", "segments", "bin", "rank"))
    begin = F.col("doc_tokens") - F.col("rest")
    solved = ranked.alias("r").join(known.alias("k"), (F.col("r.bin") == F.col("k.bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    back = F.col("rank") - F.col("low")
    solved = solved.select("rid", "doc_id", "doc_tokens", begin.alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), (F.lit(total_full) + F.col("sequence") + F.floor(back / F.col("m"))).alias("sequence_id"), (F.col("slot") + back % F.col("m")).alias("slot"))

    # what is left over: end to end, in steps of a segment
    over = ranked.join(F.broadcast(spare), "bin").where("rank >= used").withColumn("steps", F.ceil(F.col("rest") / SEGMENT))
    over = checkpointed(over.select("pid", "rid", "doc_id", "doc_tokens", "rest", "segments", "steps"))
    steps = over.groupBy("pid").agg(F.sum("steps").alias("n"))
    first = steps.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    over = over.withColumn("up_to", F.coalesce(F.sum("steps").over(inside), F.lit(0))).join(small_or_shuffled(checkpointed(first)), "pid")
    over = over.select("rid", "doc_id", "doc_tokens", "rest", "segments", begin.alias("begin"), (F.col("earlier") + F.col("up_to")).alias("first"), F.lit(slots).alias("slots"))
    cut = over.mapInArrow(_cut_pieces, "rid long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence long, slot long")
    cut = cut.select("rid", "doc_id", "doc_tokens", "start", "length", "ids_crc32", (F.lit(total_full + sequence) + F.col("sequence")).alias("sequence_id"), "slot")
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = solved.unionByName(cut).withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)))
    return full.unionByName(placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
