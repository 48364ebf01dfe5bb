"""SimHash near-duplicates: fingerprints, multi-index hashing for links, connected components for groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import arrow_mapped, checkpointed, row_key, slices, small_or_shuffled, without
from docloom.llm.components import connected_components

BITS = 64
#: A table bucket with more fingerprints than this is linked through midpoints instead of by comparing its members.
DENSE_BUCKET = 2048
#: Writing, moving and reading a row of the join costs about as much as so many comparisons of two fingerprints.
ROW_COST = 50


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text as an unsigned integer; zero for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes, lower() and split() know ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    all_hashes = np.array(hashes, "<u8")
    for i in range(0, len(all_hashes), 65_536):
        part = all_hashes[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, hash, fp) for every row: a hash of the text and the fingerprint's 64 bits, as signed longs; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "hash", "fp"])

    key, digest = row_key()
    return arrow_mapped(docs.select(key.cast("long").alias("doc_id"), digest.alias("hash"), "text"), run, "doc_id long, hash long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _around(value: Column, width: int, radius: int, tag: Column) -> Column:
    """The values within ``radius`` bits of ``value``, each with ``tag`` set."""
    masks = F.lit([x - (1 << 64) if x >> 63 else x for x in _ball(width, radius)])
    return F.transform(masks, lambda x: x.bitwiseXOR(value).bitwiseOR(tag))


def segments(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(offset, width, ball radius) of each segment, for n fingerprints.

    Two fingerprints within ``radius`` bits are within the ball radius t_i in at least one segment whenever the t_i + 1
    sum to radius + 1. Few wide segments mean many probes, many narrow ones many members in a bucket. The number with
    the least expected cost for n is taken: rows that enter the join, at ROW_COST each, and comparisons. At that choice
    nearly every value of a segment is held, so a filter of held values would drop few probes. Every choice finds the
    same links.
    """
    best = None
    for m in range(2 if radius else 1, radius + 2):
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        balls = [(radius + 1) // m + (i >= m - (radius + 1) % m) - 1 for i in range(m)]
        probes = [sum(comb(w, r) for r in range(t + 1)) for w, t in zip(widths, balls, strict=True)]
        cost = sum(ROW_COST * (p + 1) + p * n / 2**w for p, w in zip(probes, widths, strict=True))
        if best is None or cost < best[0]:
            best = (cost, [(sum(widths[:i]), w, t) for i, (w, t) in enumerate(zip(widths, balls, strict=True))])
    return best[1]


def fingerprint_links(distinct: DataFrame, radius: int = 4, dense_bucket: int = DENSE_BUCKET) -> DataFrame:
    """(src, dst) links between distinct fingerprints (column fp) that join all that differ in ``radius`` bits or fewer.

    Table side: each fingerprint once per segment. Probe side: each once per value in the small Hamming ball around
    its segment's value. Both meet in an equi-join on (segment, value), which verifies the complete distance in its
    condition. Buckets of more than ``dense_bucket`` fingerprints, where comparing members would grow with the square,
    are left to midpoints: any two fingerprints at an even distance bound r share a value within r / 2 of both, so each
    member is listed at every value within r / 2 and linked to the least member listed there. This loses no connection.
    An odd radius is therefore refused.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    n = distinct.count()
    table, probe = [], []
    for i, (offset, width, ball) in enumerate(segments(n, radius)):
        value = F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else F.col("fp")
        tag = F.lit(i << 40) if width <= 40 else F.lit(0)
        table.append(value.bitwiseOR(tag))
        probe.append(_around(value, width, ball, tag))
    held = distinct.select("fp", F.explode(F.array(*table)).alias("bucket"))
    asked = distinct.select("fp", F.explode(F.flatten(F.array(*probe))).alias("bucket"))
    dense = checkpointed(held.groupBy("bucket").count().where(F.col("count") > dense_bucket).select("bucket"))
    crowded = not dense.isEmpty()
    plain = asked.join(small_or_shuffled(dense), "bucket", "left_anti") if crowded else asked
    a, b = held.select("bucket", F.col("fp").alias("src")), plain.select("bucket", F.col("fp").alias("dst"))
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius
    links = a.join(b, (a["bucket"] == b["bucket"]) & (F.col("src") < F.col("dst")) & near).select("src", "dst")
    if crowded:
        members = checkpointed(asked.join(small_or_shuffled(dense), "bucket", "left_semi").select("fp").distinct())
        at = members.select("fp", F.explode(_around(F.col("fp"), BITS, radius // 2, F.lit(0))).alias("z"))
        least = at.groupBy("z").agg(F.min("fp").alias("src"), F.count("*").alias("n")).where("n > 1").select("z", "src")
        links = links.union(at.join(least, "z").where("src != fp").select("src", F.col("fp").alias("dst")))
    return links.distinct()


def _grouped(fps: DataFrame, radius: int, dense_bucket: int) -> DataFrame:
    """(fp, least): every fingerprint and the smallest row of its group, a struct (unnamed, doc_id, hash); null ids last."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    nodes = checkpointed(fps.groupBy("fp").agg(F.min(row).alias("least")))
    parts = checkpointed(connected_components(fingerprint_links(nodes.select("fp"), radius, dense_bucket)).withColumnRenamed("node", "fp"))
    firsts = parts.join(nodes, "fp").groupBy("component").agg(F.min("least").alias("first"))
    linked = parts.join(firsts, "component").select("fp", "first")
    return checkpointed(nodes.join(linked, "fp", "left").select("fp", F.coalesce("first", "least").alias("least")))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, dense_bucket: int = DENSE_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): every row's fingerprint and the smallest doc_id that links reach from it.

    Equal fingerprints are one node, so copies cost nothing beyond a grouping with map-side minima. Null and empty
    texts have fingerprint zero and link like any other; repeated rows are repeated in the result. A null doc_id is never
    the smallest: its row gets the smallest other id of its group, or null if there is none.
    """
    fps = fingerprints(docs, shingle)
    groups = _grouped(fps, radius, dense_bucket)
    return fps.join(small_or_shuffled(groups), "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4, dense_bucket: int = DENSE_BUCKET) -> DataFrame:
    """One row of ``docs`` from each group of near-duplicates, all columns as they came.

    Rows are told apart by doc_id and text, so different texts under one id are judged each for itself. A group keeps its
    row with the smallest doc_id (null last), among those the one with the smallest hash of its text; of rows that are
    equal in both, any one stays.
    """
    fps = fingerprints(docs, shingle)
    found = fps.join(small_or_shuffled(_grouped(fps, radius, dense_bucket)), "fp")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("hash") == F.col("least.hash"))
    kept = without(docs, found.where(~first).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")))
    again = found.where(first).groupBy("doc_id", "hash").count().where(F.col("count") > 1)
    again = checkpointed(again.select("doc_id", "hash"))
    if again.isEmpty():
        return kept
    mark = "_row"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    again = small_or_shuffled(again.select(F.col("doc_id").alias(f"{mark}a"), F.col("hash").alias(f"{mark}b")))
    keyed = kept.withColumns({f"{mark}id": F.col("doc_id").cast("long"), f"{mark}hash": F.xxhash64("text")})
    same = F.col(f"{mark}id").eqNullSafe(F.col(f"{mark}a")) & (F.col(f"{mark}hash") == F.col(f"{mark}b"))
    twice = keyed.join(again, same, "left_semi").dropDuplicates([f"{mark}id", f"{mark}hash"])
    return keyed.join(again, same, "left_anti").unionByName(twice).select(*[F.col(f"`{c}`") for c in docs.columns])
