"""Exact vector search and the hash embedding that needs no model."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v: Column) -> Column:
    """``v`` as doubles, scaled to length 1; a vector of zeros stays."""
    d = v.cast("array<double>")
    length = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(d, lambda x: x / length)).otherwise(d)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors, which all have ``width`` numbers, as rows of a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def best_of_batches(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, score) of the k rows with the largest cosine to the query, ties by key.

    One product of Arrow batches with the query in each task, where all rows of a batch are scored at once and k of them
    are kept, so what leaves a batch is bounded.
    """
    q = np.asarray(query, np.float64)
    q = q / max(np.linalg.norm(q), 1e-300)
    kind = dict(vectors.dtypes)[key]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), len(q))
            s = v @ q / np.maximum(np.linalg.norm(v, axis=1), 1e-300)
            order = np.lexsort((np.asarray(batch.column(0).to_pylist()), -s.round(9)))[:k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order)), pa.array(s[order])], [key, "score"])

    top = vectors.select(key, embedding).where(F.col(embedding).isNotNull()).mapInArrow(best, f"{key} {kind}, score double")
    return top.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows with the largest cosine to the query, ties by key, looked up in ``vectors`` with a ``score``."""
    top = best_of_batches(vectors, query, k, key, embedding)
    return vectors.join(F.broadcast(top), key).orderBy(F.desc(F.round("score", 9)), key)  # k rows


def nearest_to_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", block: int = 512) -> DataFrame:
    """(query, key, score, position) of the k nearest rows for each query (columns ``query``, ``embedding``); null vectors
    on either side are near nothing.

    Queries are taken in blocks of about a fixed size by a hash, and only one block is on the driver at a time. Each task
    multiplies its batch of vectors by the block and keeps k rows a query, so what leaves a batch is bounded by queries
    times k; a block's result is checkpointed before the next one is read.
    """
    from docloom.operators.fusion import top_of_each
    from docloom.operators.ordering import checkpointed

    vectors, queries = vectors.where(F.col(embedding).isNotNull()), queries.where("query IS NOT NULL AND embedding IS NOT NULL")
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.select("query", "embedding", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"))
    out = None
    for i in range(blocks):
        part = numbered.where(F.col("block") == i).orderBy("query").collect()
        if not part:
            continue
        names = [r["query"] for r in part]
        q = np.array([r["embedding"] for r in part], np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def best(batches: Iterator[pa.RecordBatch], q: np.ndarray = q, names: list = names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.array(batch.column(0).to_pylist())
                if not len(ids):
                    continue
                v = matrix(batch.column(1), q.shape[1])
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                s = v @ q.T
                for j, name in enumerate(names):
                    top = np.lexsort((ids, -s[:, j].round(9)))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(top), pa.int64()), pa.array(ids[top], pa.int64()), pa.array(s[top, j])], ["query", key, "score"])

        found = vectors.select(F.col(key).cast("long").alias(key), embedding).mapInArrow(best, f"query long, {key} long, score double")
        found = top_of_each(found, ["query"], [F.desc(F.round("score", 9)), F.col(key)], k)
        found = checkpointed(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = f"query long, {key} long, score double, position int"
        return vectors.sparkSession.createDataFrame([], kind)
    return out


#: Grams, and words, whose places a worker keeps; others are computed anew. Bounds memory, not results.
MEMO_GRAMS = 1 << 21
#: Characters of a text that are looked up at once.
GRAM_BLOCK = 1 << 16
_words: dict[tuple[str, int], tuple[int, int]] = {}


def _hashed(gram: str, dimension: int) -> tuple[int, int]:
    h = hashlib.md5(gram.encode()).digest()
    return int.from_bytes(h[:4], "little") % dimension, int.from_bytes(h[4:8], "little") % dimension


def _place(gram: str, dimension: int) -> tuple[int, int]:
    found = _words.get((gram, dimension))
    if found is None:
        found = _hashed(gram, dimension)
        if len(_words) >= MEMO_GRAMS // 10:
            _words.clear()
        _words[gram, dimension] = found
    return found


@lru_cache(maxsize=1)
def _memo(slots: int, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each slot the gram that it holds, as its first three characters and its fourth, and the gram's two places as one number."""
    return np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.int64)


def _places(text: str, n: int, dimension: int) -> np.ndarray:
    """The two places of each of the text's n-grams, of 2 to 4 characters, as first times dimension plus second; a gram that
    is not in its slot takes the slot."""
    first, fourth, places = _memo(MEMO_GRAMS, dimension)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + 1  # 21 bits, 0 where a gram has no character
    size = len(text) - n + 1
    low = codes[:size].copy()
    for j in range(1, min(n, 3)):
        low |= codes[j : size + j] << np.uint64(21 * j)
    high = codes[3 : size + 3].astype(np.uint32) if n == 4 else np.zeros(size, np.uint32)
    mixed = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    slot = ((mixed >> np.uint64(32)) % np.uint64(len(first))).astype(np.int64)
    found = places[slot]
    missing = np.flatnonzero((first[slot] != low) | (fourth[slot] != high))
    if len(missing):
        grams = [text[i : i + n] for i in missing.tolist()]
        own = {g: plus * dimension + minus for g in set(grams) for plus, minus in [_hashed(g, dimension)]}
        found[missing] = [own[g] for g in grams]
        taken = missing[np.unique(slot[missing], return_index=True)[1]]
        first[slot[taken]], fourth[slot[taken]], places[slot[taken]] = low[taken], high[taken], found[taken]
    return found


def hash_vector(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """Character 2-, 3- and 4-grams add 1 and take 0.5, words add 2, each at a place given by MD5; unit length.

    A worker keeps the places of grams in a table, where all grams of a block of the text are looked up at once.
    """
    v = np.zeros(dimension)
    for n in (2, 3, 4):
        if len(text) < n:
            plus, minus = _place(text, dimension)
            v[plus] += 1.0
            v[minus] -= 0.5
        for i in range(0, len(text) - n + 1, GRAM_BLOCK):
            places = _places(text[i : i + GRAM_BLOCK + n - 1], n, dimension)
            v += np.bincount(places // dimension, minlength=dimension) - 0.5 * np.bincount(places % dimension, minlength=dimension)
    for word, n in Counter(text.lower().split() if text.isascii() else [w.lower() for w in text.split()]).items():
        v[_place(word, dimension)[0]] += 2.0 * n
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def hash_embedding(docs: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, embedding) by ``hash_vector``, in Arrow batches. Rows are dealt out first, as a file's row groups, which are read
    whole, may be fewer than there are cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((batch.num_rows, dimension), np.float32)
            for i, t in enumerate(batch.column(1)):
                v[i] = hash_vector(t.as_py() or "", dimension)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dimension, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], [key, "embedding"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).repartition(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def append_vectors(index: DataFrame, new: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """The index with new rows, scaled to length 1, which replace those of the same key. Of new rows with one key the one
    with the largest vector stays (number by number; null is the smallest), so the result does not hang on their order;
    rows without a key are left out."""
    others = [F.col(c) for c in new.columns if c not in (key, embedding) and not new.schema[c].dataType.simpleString().startswith("map")]
    whole = F.struct(*[F.col(c) for c in new.columns])
    one = new.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(F.col(embedding), *others)).alias("_row")).select("_row.*")
    one = one.withColumn(embedding, unit(F.col(embedding)).cast(index.schema[embedding].dataType))
    return index.join(one.select(key), key, "left_anti").unionByName(one)


def without_documents(index: DataFrame, gone: DataFrame, doc: str = "doc_id") -> DataFrame:
    return index.join(gone.select(doc), doc, "left_anti")
