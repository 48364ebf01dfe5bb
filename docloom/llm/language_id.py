"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import arrow_mapped, checkpointed, row_key, slices, small_batches, small_or_shuffled, without

#: Symbols of a gram: the one predicted and up to three before it within the same word.
ORDER = 4
#: At most so many different labelled documents a language are learned from, those with the smallest hashes: the bounded sample.
SAMPLE_DOCS = 2000
#: Of the sample, one in so many calibrates instead.
CALIBRATE = 5
#: Symbols that a model reckons with beyond those it has seen.
ALPHABET = 1 << 16
#: Symbols that a task scores at a time.
GROUP = 1 << 18
#: A text is rejected if its best model needs so many bits a symbol more than nearly all calibrating documents did, plus
#: SHORT bits shared out over the symbols, or if its score is below LEAST_SCORE.
SLACK, SHORT, LEAST_SCORE = 1.0, 24.0, 0.5
PRIME = np.uint64(0x9E3779B97F4A7C15)

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def symbols(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters; each run of anything else, and either end, is one 0."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4")
    x = np.concatenate([[0], np.where(_letters()[x], x, 0), [0]]).astype(np.uint32)
    return x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]


def _grams(x: np.ndarray) -> list[np.ndarray]:
    """For every symbol but the first: itself and the ones before it, nearest first; 0 beyond the word's start."""
    out = [x[1:].astype(np.uint64)]
    alive = np.ones(len(x) - 1, bool)
    for back in range(1, ORDER):
        before = np.zeros(len(x) - 1, np.uint64)
        before[back - 1 :] = x[: len(x) - back]
        before[~alive] = 0
        alive = before != 0
        out.append(before)
    return out


def _key(parts: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        key = (key + p + np.uint64(1)) * PRIME
        key ^= key >> np.uint64(29)
    return key


def _look(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Model:
    """grams[k]: sorted hashes of all grams of k symbols and, for each language, their log2 probability. contexts[k]:
    sorted hashes of what stands before the last of k symbols and the log2 weight of the next lower order."""

    langs: list[str] = field(default_factory=list)
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    unseen: np.ndarray | None = None
    sharpness: float = 8.0
    limits: np.ndarray | None = None

    def log2p(self, parts: list[np.ndarray], order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.broadcast_to(self.unseen, (len(parts[0]), len(self.langs)))
        hashes, values = self.grams[order]
        at, hit = _look(hashes, _key(parts[:order]))
        out = values[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest = [p[miss] for p in parts]
            lower = self.log2p(rest, order - 1)
            if order > 1:
                hashes, values = self.contexts[order]
                at, hit = _look(hashes, _key(rest[1:order]))
                lower = lower + np.where(hit[:, None], values[at], np.float32(0))
            out[miss] = lower
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol under each language, and the number of symbols, of each text; whole texts, in bounded groups."""
        bits, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        size = begin = 0
        for i, text in enumerate(texts):
            held.append(symbols(text))
            size += len(held[-1])
            if size >= GROUP or i + 1 == len(texts):
                self._add(held, bits[begin : i + 1], n[begin : i + 1])
                held, size, begin = [], 0, i + 1
        return bits / np.maximum(n, 1)[:, None], n

    def _add(self, held: list[np.ndarray], bits: np.ndarray, n: np.ndarray) -> None:
        x = np.concatenate(held)
        owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
        for lo in range(1, len(x), GROUP):
            hi = min(len(x), lo + GROUP)
            first = max(0, lo - ORDER)
            parts = [p[lo - first - 1 :] for p in _grams(x[first:hi])]
            own = owner[lo:hi]
            counted = own == owner[lo - 1 : hi - 1]  # the 0 at a text's start is not predicted
            scores = -self.log2p([p[counted] for p in parts])
            own = own[counted]
            n += np.bincount(own, minlength=len(held))
            for j in range(len(self.langs)):
                bits[:, j] += np.bincount(own, scores[:, j], len(held))

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, bits a symbol, rejected) of each text."""
        if not self.langs:
            return [("und", 0.0, None, True)] * len(texts)
        bits, n = self.cross_entropy(texts)
        best = bits.argmin(1)
        power = np.exp2(-self.sharpness * (bits - bits.min(1)[:, None]))
        score = 1 / power.sum(1)
        least = bits[np.arange(len(best)), best]
        letters = n > 1  # a text without letters is one 0 at either end, run together
        reject = ~letters | (least > self.limits[best] + SLACK + SHORT / np.maximum(n, 1)) | (score < LEAST_SCORE)
        return [(self.langs[b], float(s), float(c), bool(r)) if ok else ("und", 0.0, None, True) for b, s, c, r, ok in zip(best, score, least, reject, letters, strict=True)]


def kneser_ney(counts: pd.DataFrame) -> Model:
    """A model from columns lang, s0 (last symbol), s1, ..., n: how often each full gram was seen."""
    model = Model(langs=sorted(counts["lang"].unique()))
    if not model.langs:
        return model
    names = [f"s{i}" for i in range(ORDER)]
    steps: list[dict[int, tuple]] = []
    for lang in model.langs:
        seen, own = counts[counts["lang"] == lang], {}
        for k in range(ORDER, 0, -1):
            grams = seen.groupby(names[:k], sort=False)["n"]
            # the highest order counts occurrences, lower ones the different symbols in front
            grams = (grams.sum() if k == ORDER else grams.size()).reset_index(name="n")
            seen = grams
            c = grams["n"].to_numpy(float)
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            parts = [grams[x].to_numpy(np.uint64) for x in names[:k]]
            context = _key(parts[1:]) if k > 1 else np.zeros(len(c), np.uint64)
            unique, at = np.unique(context, return_inverse=True)
            total, types = np.bincount(at, c), np.bincount(at)
            alpha = np.maximum(c - discount, 0) / total[at]
            keys = _key(parts)
            order = np.argsort(keys)
            own[k] = (keys[order], alpha[order], unique, discount * types / total)
        steps.append(own)

    def probability(own: dict, parts: list[np.ndarray], k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(parts[0]), 1 / ALPHABET)
        keys, alpha, contexts, weight = own[k]
        at, hit = _look(keys, _key(parts[:k]))
        where, known = _look(contexts, _key(parts[1:k]) if k > 1 else np.zeros(len(parts[0]), np.uint64))
        return np.where(hit, alpha[at], 0) + np.where(known, weight[where], 1) * probability(own, parts, k - 1)

    for k in range(1, ORDER + 1):
        rows = counts[names[:k]].drop_duplicates()
        parts = [rows[x].to_numpy(np.uint64) for x in names[:k]]
        keys = _key(parts)
        order = np.argsort(keys)
        values = np.stack([np.log2(probability(own, parts, k)) for own in steps], 1).astype(np.float32)
        model.grams[k] = (keys[order], values[order])
        if k > 1:
            contexts = np.unique(np.concatenate([own[k][2] for own in steps]))
            weights = np.zeros((len(contexts), len(steps)), np.float32)
            for j, own in enumerate(steps):
                at, hit = _look(own[k][2], contexts)
                weights[hit, j] = np.log2(own[k][3][at[hit]])
            model.contexts[k] = (contexts, weights)
    model.unseen = np.array([np.log2(own[1][3][0] / ALPHABET) for own in steps], np.float32)
    model.limits = np.full(len(model.langs), np.inf)
    return model


def sampled(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, draw, text): the different labelled texts with the smallest draws, ``sample_docs`` a language at most.

    One narrow scan counts the rows of each language, a second one keeps the rows whose hash is below the share wanted
    (and a fifth more), so that only about so many texts are shuffled and written. Repeated rows share a hash and count
    once, however many there are.
    """
    rows = labelled.where("lang IS NOT NULL")
    sizes = checkpointed(rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_docs")))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "lang", "text"), 11) / float(1 << 53)
    near = rows.select("lang", draw.alias("draw"), "text").where("text IS NOT NULL").join(small_or_shuffled(sizes), F.col("lang") == F.col("_lang"))
    near = near.where(F.col("draw") * F.col("_docs") < 1.2 * sample_docs + 50).groupBy("lang", "draw").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return checkpointed(near.withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("lang", "draw", "text"))


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows (doc_id, text, lang); rows without text or lang are left out, and so are others' columns.

    Counting runs in tasks; only the counts of different grams of the bounded sample reach the driver. A fifth of the
    sample takes no part in counting: it sets how sharply differences between languages count, and how many bits a
    symbol a text may need before it is rejected.
    """
    texts = sampled(labelled, sample_docs)
    aside = F.pmod(F.floor(F.col("draw") * float(1 << 53)), F.lit(CALIBRATE)) == 0
    fields = [("lang", pa.string()), *((f"s{i}", pa.int64()) for i in range(ORDER)), ("n", pa.int64())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.setdefault(lang, []).append(symbols(text))
            for lang, held in own.items():
                x = np.concatenate(held)
                starts = np.cumsum([0, *(len(h) for h in held)])[1:-1]
                parts = np.stack(_grams(x), 1).astype(np.int64)
                parts = np.delete(parts, starts - 1, 0)
                unique, n = np.unique(parts, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *(pa.array(unique[:, i]) for i in range(ORDER)), pa.array(n)], schema=pa.schema(fields))

    names = ["lang", *(f"s{i}" for i in range(ORDER))]
    counts = texts.where(~aside).select("lang", "text").mapInArrow(count, ", ".join(f"{n} {'string' if n == 'lang' else 'long'}" for n in [*names, "n"]))
    with small_batches(labelled.sparkSession):
        model = kneser_ney(counts.groupBy(*names).agg(F.sum("n").alias("n")).orderBy(*names).toPandas())
    if not model.langs:
        return model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits, n = model.cross_entropy(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(n)], ["lang", "bits", "n"])

    held = texts.where(aside).select("lang", "text").mapInArrow(score, "lang string, bits array<double>, n long").where("n > 1").orderBy("lang", "n", "bits").collect()
    if held:
        bits = np.array([r["bits"] for r in held])
        true = np.array([model.langs.index(r["lang"]) if r["lang"] in model.langs else -1 for r in held])
        bits, true = bits[true >= 0], true[true >= 0]
        over = bits - bits.min(1)[:, None]
        loss = [np.mean(over[np.arange(len(true)), true] * s + np.log2(np.exp2(-s * over).sum(1))) for s in (1, 2, 4, 8, 16, 32)]
        model.sharpness = float((1, 2, 4, 8, 16, 32)[int(np.argmin(loss))])
        for j in range(len(model.langs)):
            own = bits[(true == j) & (bits.argmin(1) == j), j]
            model.limits[j] = np.quantile(own, 0.999) if len(own) else bits.min(1).max()
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the CRC-32 of the id as text is divisible by 5; a null id counts as an empty text, so it is true."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text's language ``lang_pred``, ``score`` (0 to 1), ``bits`` a symbol, ``rejected`` and ``_hash`` (of the
    text), a row for each row; checkpointed.

    ``und`` with score 0, rejected, if a text is null or has no letter. Equal cross-entropies take the first language
    in sorted order. Other texts always get a learned language; ``rejected`` says that no model fits them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model.judge(batch.column(1).to_pylist())
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], ["doc_id", "lang_pred", "score", "bits", "rejected", "_hash"])

    key, digest = row_key()
    return arrow_mapped(docs.select(key.cast("long").alias("doc_id"), "text", digest), run, "doc_id long, lang_pred string, score double, bits double, rejected boolean, _hash long")


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and judges every row: doc_id, held_out, lang_pred, score, bits, rejected."""
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits", "rejected")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which a learned language was recognised, all columns as they came."""
    found = identify(docs, learn(docs.where(~held_out())))
    return without(docs, found.where("rejected").select(F.col("doc_id").alias("_id"), "_hash"))
