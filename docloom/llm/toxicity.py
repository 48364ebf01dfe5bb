"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is, and only documents are labelled."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import arrow_mapped, checkpointed, slices, small_batches

#: At most so many labelled documents of each label are learned from, those with the smallest hashes; a fifth calibrates.
SAMPLE_DOCS, CALIBRATE = 4_000, 5
#: A feature counts if so many documents of the sample have it and its log-likelihood ratio (G2) against the labels is this
#: at least; of those the MOST_FEATURES with the largest ratio.
LEAST_DOCS, LEAST_RATIO, MOST_FEATURES = 3, 12.0, 20_000
#: Letters of a word's beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6)
#: Rounds of gradient steps, and the weight of the penalty on squared weights.
ROUNDS, PENALTY = 150, 1e-4
#: A score from this on predicts label 1.
THRESHOLD = 0.3
#: Different words whose weights a task remembers.
MEMO_WORDS = 100_000

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?\n]+")


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """Start, end and different lower-cased words of the sentences that hold a word. A sentence ends behind a run of full
    stops, marks or line ends."""
    text, found, start = text or "", [], 0
    for end in (*(m.end() for m in _SENTENCE_END.finditer(text)), len(text)):
        words = list(dict.fromkeys(_WORD.findall(text[start:end].lower())))
        if words:
            found.append((start, end, words))
        start = end
    return found


def word_features(word: str) -> list[str]:
    """A lower-cased word and its beginnings, each told apart from whole words."""
    return [word, *(f"{word[:k]}-" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    """Weights of features, a sentence's bias, and the shift of a document's log-odds that puts the calibrated limit at THRESHOLD."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    shift: float = 0.0
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def of_word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MEMO_WORDS:
                self.known.clear()
            found = self.known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return found

    def log_odds(self, words: list[str]) -> float:
        """Of a sentence with these words."""
        return self.bias + sum(map(self.of_word, words))

    def document(self, log_odds: list[float]) -> float:
        """Noisy-or of the sentences, on the calibrated scale; a text without sentences has the least score a text can have."""
        if not log_odds:
            return float(_sigmoid(np.array(-30.0)))
        return float(_sigmoid(np.clip(_noisy_or(-np.logaddexp(0, log_odds).sum()) + self.shift, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _noisy_or(log_none: np.ndarray) -> np.ndarray:
    """Log-odds of "some", from the log-probability of "none"."""
    return np.log(np.maximum(-np.expm1(np.minimum(log_none, -1e-12)), 1e-12)) - log_none


def fit(names: list[str], documents: list[list[list[int]]], toxic: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """A model from documents, the numbers in ``names`` of the features of each of their sentences, and labels, 0 or 1.

    The likelihood of the documents' labels under the noisy-or of their sentences is climbed by Adam over the whole
    sample. The derivative by a sentence's log-odds is p (y - P) / P, so that in a toxic document the sentences that
    explain it best take the blame. Labels are weighted to equal sums.
    """
    if not names or not len(toxic) or toxic.min() == toxic.max():
        return Model()
    columns = [f for d in documents for s in d for f in s]
    sizes, of_document = [len(s) for d in documents for s in d], [k for k, d in enumerate(documents) for _ in d]
    column = np.array(columns, np.int32)
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    of_document, y = np.array(of_document, np.int64), toxic.astype(float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    x, bias = np.zeros(len(names)), -4.0
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):
        z = np.clip(np.bincount(sentence, x[column], len(sizes)) + bias, -30, 30)
        p = _sigmoid(z)
        some = -np.expm1(np.minimum(np.bincount(of_document, -np.logaddexp(0, z), len(y)), -1e-12))
        pull = (share * (y - some) / np.maximum(some, 1e-12))[of_document] * p
        up = np.append(np.bincount(column, pull[sentence], len(names)) - penalty * x, pull.sum())
        first, second = 0.9 * first + 0.1 * up, 0.999 * second + 0.001 * up**2
        change = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        x, bias = x + change[:-1], bias + change[-1]
    return Model({f: float(v) for f, v in zip(names, x, strict=True) if abs(v) > 1e-3}, float(bias))


def calibrate(model: Model, log_odds: list[list[float]], toxic: np.ndarray) -> None:
    """Shifts documents' log-odds so that THRESHOLD lies where F1 is best over documents that the model has not seen;
    in the middle between the neighbours of the limit."""
    model.shift = 0.0
    z = np.array([_noisy_or(-np.logaddexp(0, s).sum()) if s else -30.0 for s in log_odds])
    order = np.argsort(-z, kind="stable")
    z, y = z[order], toxic[order]
    if not len(y) or y.min() == y.max():
        return
    right = np.cumsum(y)
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = 0  # a limit lies between different values
    k = int(np.argmax(f1))
    limit = (z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - limit)


def sampled(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(toxic, draw, text): at most ``sample_docs`` texts of each label, those with the smallest draws; checkpointed.

    Draws are made on ids and hashes; a bounded number of them is sent to the scan, so only the sample's texts move.
    Repeated rows share a draw and count once. Ids that are labelled both 0 and 1 are left out.
    """
    own = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most AND toxic IN (0, 1)")
    rows = docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("draw"))
    drawn = checkpointed(rows.select("doc_id", "draw").join(own, F.col("doc_id") == F.col("_id")).select(F.col("toxic").cast("int").alias("toxic"), "_id", "draw").distinct())
    sizes = drawn.groupBy(F.col("toxic").alias("_toxic")).agg(F.count("*").alias("n"))  # two rows at most
    near = drawn.join(F.broadcast(sizes), F.col("toxic") == F.col("_toxic")).where(F.col("draw") / float(1 << 63) * F.col("n") < 1.2 * sample_docs + 50)
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "_id"))
    taken = near.withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("toxic", "_id", F.col("draw").alias("_draw"))
    found = rows.join(F.broadcast(taken), (F.col("doc_id") == F.col("_id")) & (F.col("draw") == F.col("_draw")))
    return checkpointed(found.groupBy("toxic", "draw").agg(F.first("text").alias("text")))


def informative(sample: DataFrame) -> list[str]:
    """The features of the sample's documents that tell most about their labels, best first.

    G2 compares in how many documents of either label a feature stands with what its share would be without a link.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            seen: dict[tuple[str, int], int] = {}
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for f in {f for _, _, words in sentences(text) for w in words for f in word_features(w)}:
                    seen[f, y] = seen.get((f, y), 0) + 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["feature", "toxic", "n"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return []
    d = sample.select("toxic", "text").mapInArrow(cut, "feature string, toxic int, n long").groupBy("feature").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    share, ratio = (F.col("n0") + F.col("n1")) / sum(totals.values()), F.lit(0.0)
    for y, total in totals.items():
        for n, expected in ((F.col(f"n{y}"), total * share), (total - F.col(f"n{y}"), total * (1 - share))):
            ratio = ratio + F.when(n > 0, 2 * n * F.ln(n / expected)).otherwise(0.0)
    d = d.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).withColumn("ratio", F.round(ratio, 9)).where(F.col("ratio") >= LEAST_RATIO)
    return [r["feature"] for r in d.orderBy(F.desc("ratio"), "feature").limit(MOST_FEATURES).select("feature").collect()]


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from documents (doc_id, text) and ``labels`` (doc_id, toxic).

    Words are cut and features counted in tasks; the driver gets the features that count and where the bounded sample
    has them, and climbs the likelihood. A fifth of the sample is not fitted: it sets the limit. Without documents of
    both labels every score is that of no toxicity.
    """
    with small_batches(docs.sparkSession):
        sample = sampled(docs, labels, sample_docs)
        names = informative(sample.where(F.col("draw") % CALIBRATE != 0))
        number = {f: i for i, f in enumerate(names)}

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 200):
                found = [[[number[f] for w in words for f in word_features(w) if f in number] for _, _, words in sentences(t)] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("draw"), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["toxic", "draw", "found"])

        rows = sample.mapInArrow(placed, "toxic int, draw long, found array<array<int>>").orderBy("draw", "toxic").collect() if names else []
    aside = np.array([r["draw"] % CALIBRATE == 0 for r in rows], bool)
    found, toxic = [r["found"] for r in rows], np.array([r["toxic"] for r in rows], int)
    model = fit(names, [d for d, a in zip(found, aside, strict=True) if not a], toxic[~aside])
    weight = [model.weights.get(f, 0.0) for f in names]
    calibrate(model, [[model.bias + sum(weight[f] for f in s) for s in d] for d, a in zip(found, aside, strict=True) if a], toxic[aside])
    return model


def held_out() -> Column:
    """True where the CRC-32 of the id as text leaves 2 when divided by 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), offending: a row for each row of ``docs`` (doc_id, text), checkpointed; other columns are left out.

    ``offending`` lists the sentences that alone would reach THRESHOLD (start and length in characters, score), in the
    order of the text. Null and empty texts, and those without a word, have the least score there is and no sentences;
    repeated rows have the same result each.
    """
    sentence = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores, found = [], []
            for text in batch.column("text").to_pylist():
                own = [(a, b, model.log_odds(words)) for a, b, words in sentences(text)]
                scores.append(model.document([z for _, _, z in own]))
                alone = [(a, b, model.document([z])) for a, b, z in own if z > model.bias] if scores[-1] >= THRESHOLD else []
                found.append([{"start": a, "length": b - a, "score": p} for a, b, p in alone if p >= THRESHOLD])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(sentence))], ["doc_id", "score", "offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, offending array<struct<start:int, length:int, score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels of the rows that are not held out and scores every row: doc_id, held_out, score, predicted, offending."""
    model = learn(docs.where(~held_out()), labels)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted, "offending")
