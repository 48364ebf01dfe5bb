"""Pairs that meet in common things, summed up where they meet: pairs themselves are never shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ordering import checkpointed, numbered, small_or_shuffled
from docloom.operators.wedges import flat, ranges, sums

#: Names of a block, in order: a cell of two blocks holds the square of this many pairs at most.
BLOCK = 2048
#: Pairs that a task makes, about; partitions are as many as that takes, within bounds.
TASK_PAIRS, MOST_TASKS = 20_000_000, 20_000
#: A cell is summed up in arrays of all its pairs if it has a wedge for so many of them, and what two blocks have in common by
#: products of matrices, so many at a time, if it joins one pair of so many.
DENSE, PRODUCT, AT_ONCE = 8, 64, 128
#: Pairs that are made, and sent, at a time.
BATCH = 262_144
VALUES = ["direct", "common", "shared"]


def tasks(spark: SparkSession, n: int, each: int) -> int:
    """As many as ``n`` takes, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, int(n // each)))


def summed(members: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(src, dst, direct, common, shared), 0 where there is none, of names that meet in ``members`` or ``edges``, each pair once.

    ``members`` (kind, id, name, worth) says in which things names meet, each name once in each: neighbours (kind 2), whose
    worth is summed up as ``common``, and documents (3), of which a name has as many as ``sizes`` (name, n) says: those of both
    ends are ``shared`` as a part of the smaller set. ``edges`` (src, dst,
    direct) have the smaller name first.

    A thing's names are lists by blocks of names, and a list is sent once to each block that has others of its thing, so what is
    shuffled is rows times blocks and never pairs. A task holds a cell of two blocks, and gives a row for each of its names.
    """
    spark, kind = members.sparkSession, dict(members.dtypes)["name"]
    ends = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    every = members.select("name").union(ends).where("name IS NOT NULL").distinct()
    block = numbered(every, [], ["name"]).select("name", F.floor((F.col("n") - 1) / BLOCK).cast("int").alias("block"), F.pmod(F.col("n") - 1, F.lit(BLOCK)).cast("short").alias("at"))
    block = checkpointed(block)
    known = small_or_shuffled(block)
    lists = members.join(known, "name").groupBy("kind", "id", "block").agg(F.sort_array(F.collect_list("at")).alias("at"), F.first("worth").alias("worth"))
    lists = checkpointed(lists)
    direct = edges
    for end, to, at in (("src", "a", "x"), ("dst", "b", "y")):
        direct = direct.join(known.select(F.col("name").alias(end), F.col("block").alias(to), F.col("at").alias(at)), end)
    direct = direct.groupBy("a", "b", "x").agg(F.collect_list(F.struct("y", "direct")).alias("o"))
    direct = checkpointed(direct.select("a", "b", F.lit(4).alias("kind"), F.array("x").alias("xs"), F.col("o.y").alias("ys"), F.col("o.direct").alias("worth")))

    via = ["kind", "id"]
    theirs = lists.select(*via, F.col("block").alias("b"))
    cell = lists.select(*via, F.col("block").alias("a")).join(theirs, via).where("a <= b").select("a", "b")
    cell = checkpointed(cell.union(direct.select("a", "b")).distinct())
    named = block.join(sizes, "name", "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "name", F.coalesce("n", F.lit(0)).cast("double").alias("n")))).alias("o"))
    named = checkpointed(named.select("block", F.col("o.name").alias("names"), F.col("o.n").alias("counts")))

    none = [F.lit(None).cast(t).alias(c) for c, t in (("xs", "array<short>"), ("ys", "array<short>"), ("worth", "array<double>"))]
    rows = [cell.where("a < b" if i else "true").join(named.withColumnRenamed("block", end), end).select("a", "b", F.lit(i).alias("kind"), "names", "counts", *none) for i, end in enumerate("ab")]
    met = lists.select(*via, F.col("block").alias("a"), F.col("at").alias("xs"), F.array("worth").alias("worth")).join(lists.select(*via, F.col("block").alias("b"), F.col("at").alias("ys")), via).where("a <= b")
    met = met.select("a", "b", "kind", "xs", "ys", "worth").unionByName(direct)
    met = met.select("a", "b", "kind", F.lit(None).cast(f"array<{kind}>").alias("names"), F.lit(None).cast("array<double>").alias("counts"), "xs", "ys", "worth")
    d = rows[0].unionByName(rows[1]).unionByName(met).repartition(tasks(spark, cell.count() * BLOCK * BLOCK, TASK_PAIRS), "a", "b")
    d = d.groupBy("a", "b").applyInArrow(_pairs, f"src {kind}, dst array<{kind}>, " + ", ".join(f"{c} array<double>" for c in VALUES))
    # plain arrays, read by position, cost less than rows of a struct; one that is null has nothing for its whole row
    return d.select("src", F.posexplode("dst").alias("_at", "_dst"), *VALUES).select("src", F.col("_dst").alias("dst"), *[F.coalesce(F.col(c)[F.col("_at")], F.lit(0.0)).alias(c) for c in VALUES])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell: names of either block (kinds 0 and 1, the second only if it is another), lists of those who meet in a thing
    (2 and 3) and edges (4). Gives (src, dst, direct, common, shared), lists but for ``src``, null where there is nothing."""
    rows = pa.Table.from_batches(list(batches))
    kind = rows["kind"].to_numpy()
    first, second, *met = (rows.filter(pa.array(kind == k)) for k in range(5))
    other = len(second) > 0
    sides = [(pc.list_flatten(s["names"]).combine_chunks(), flat(s["counts"], np.float64)[0]) for s in (first, second if other else first)]
    (left, n_left), (right, n_right) = sides
    shape = len(left), len(right)
    found = _of_many if sum(_made(m) for m in met) * DENSE >= shape[0] * shape[1] else _of_few
    for x, y, common, both, direct in found(met, shape, other):
        if both is not None:
            both = both / np.maximum(np.minimum(n_left[x], n_right[y]), 1)  # none of both is none of any
        begin = np.flatnonzero(np.diff(x, prepend=-1))
        ends = pa.array(np.append(begin, len(x)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) if v is not None else pa.nulls(len(begin), pa.list_(pa.float64())) for v in (direct, common, both)]
        yield pa.RecordBatch.from_arrays([left.take(pa.array(x[begin])), pa.ListArray.from_arrays(ends, right.take(pa.array(y))), *lists], ["src", "dst", *VALUES])


def _made(rows: pa.Table) -> int:
    return int((flat(rows["xs"], np.int64)[1] * flat(rows["ys"], np.int64)[1]).sum())


def _keys(rows: pa.Table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, worth): every x of a row beside every y of it, about BATCH at a time."""
    (xs, nx), (ys, ny), (worth, nw) = flat(rows["xs"], np.int64), flat(rows["ys"], np.int64), flat(rows["worth"], np.float64)
    row = np.repeat(np.arange(len(rows)), nx)
    sizes, starts, at = ny[row], (np.cumsum(ny) - ny)[row], (np.cumsum(nw) - nw)[row]
    through, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
    while begin < len(xs):
        end = max(begin + 1, int(np.searchsorted(through, through[begin] + BATCH, "right")) - 1)
        part = slice(begin, end)
        which = ranges(starts[part], sizes[part])
        one = np.repeat(nw[row[part]] == 1, sizes[part])  # a row has one worth, or one for each y
        yield np.repeat(xs[part] * width, sizes[part]) + ys[which], worth[np.where(one, np.repeat(at[part], sizes[part]), ranges(at[part], sizes[part]))] if not one.all() else np.repeat(worth[at[part]], sizes[part])
        begin = end


def _of_few(met: list[pa.Table], shape: tuple[int, int], other: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, common, both, direct) of the pairs of a cell of few, from sorted keys; None is nothing for all."""
    width = shape[1]
    parts = []
    for m in met:
        made = list(_keys(m, width))
        keys, worth = (np.concatenate(c) for c in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0))
        if not other:
            upward = keys % width > keys // width
            keys, worth = keys[upward], worth[upward]
        parts.append(sums(keys, worth, shape[0] * width))
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = []
    for k, v in parts:
        values.append(np.zeros(len(keys)))
        values[-1][np.searchsorted(keys, k)] = v
    for at in range(0, len(keys), BATCH):
        part = slice(at, at + BATCH)
        x = keys[part] // width
        yield x, keys[part] - x * width, *(v[part] if v[part].any() else None for v in values)


def _of_many(met: list[pa.Table], shape: tuple[int, int], other: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """As ``_of_few``, in arrays of all pairs of a cell."""
    totals = []
    for m in met:
        if not len(m):
            totals.append(None)
            continue
        total, hit = np.zeros(shape), None
        if m is met[2]:
            hit = np.zeros(shape, bool)  # an edge may give nothing
            sparse = m
        else:
            (xs, nx), (ys, ny) = flat(m["xs"], np.int64), flat(m["ys"], np.int64)
            worth, much = flat(m["worth"], np.float64)[0], nx * ny * PRODUCT >= shape[0] * shape[1]
            x0, y0 = np.cumsum(nx) - nx, np.cumsum(ny) - ny
            dense = np.flatnonzero(much)
            for at in range(0, len(dense), AT_ONCE):
                some = dense[at : at + AT_ONCE]
                a, b = np.zeros((len(some), shape[0])), np.zeros((len(some), shape[1]))
                a[np.repeat(np.arange(len(some)), nx[some]), xs[ranges(x0[some], nx[some])]] = np.repeat(worth[some], nx[some])
                b[np.repeat(np.arange(len(some)), ny[some]), ys[ranges(y0[some], ny[some])]] = 1
                total += a.T @ b
            sparse = m.filter(pa.array(~much))
        for keys, worth in _keys(sparse, shape[1]):
            np.add.at(total.reshape(-1), keys, worth)
            if hit is not None:
                hit.reshape(-1)[keys] = True
        totals.append((total, total > 0 if hit is None else hit))
    step = max(1, BATCH // shape[1])
    for at in range(0, shape[0], step):
        rows = slice(at, min(at + step, shape[0]))
        here = [None if t is None or not t[1][rows].any() else t[0][rows].reshape(-1) for t in totals]
        mask = np.zeros((rows.stop - at, shape[1]), bool)
        for t, h in zip(totals, here, strict=True):
            if h is not None:
                mask |= t[1][rows]
        if not other:
            mask &= np.arange(shape[1])[None, :] > np.arange(at, rows.stop)[:, None]
        key = np.flatnonzero(mask)
        if len(key):
            x = np.repeat(np.arange(rows.stop - at), mask.sum(axis=1))
            yield x + at, key - x * shape[1], *(None if h is None else h[key] for h in here)
