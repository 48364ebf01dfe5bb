"""Detection of periodic runs of words: every lag compared at once, and stretches of equal words told apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import BLANK, arrow_mapped, checkpointed, count_words, slices, words_of

#: A run repeats at least so often, and has so many words at least.
MIN_EXPONENT, MIN_WORDS = 2, 12
#: Comparisons that numpy makes at once; and about so many for each range of lags of a long text, dealt to MOST_RANGES tasks at most.
BLOCK_CELLS, RANGE_CELLS, MOST_RANGES = 1 << 18, 1 << 28, 256
THINNED = 8
RUN = "array<struct<start:int, length:int, period:int>>"


def word_numbers(words: list[str]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[str, int] = {}
    numbers = [known.setdefault(w, len(known)) for w in words]
    return np.array(numbers, np.int16 if len(known) < 32_000 else np.int32)


def _smaller_period(x: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether x[start:end] has a period that divides q. Any smaller one does, where it repeats twice at least."""
    left, p = q, 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            d = q // p
            if np.array_equal(x[start : end - d], x[start + d : end]):
                return True
            while left % p == 0:
                left //= p
        p += 1
    return False


def runs_of_lags(x: np.ndarray, low: int, high: int, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs whose period lies in [low, high), by period, then start.

    Blocks of lags are compared in one array operation each, whatever the lag; x[i] == x[i + lag] over a stretch of m
    places makes a run of m + lag words. All stretches that can count have a common least length, to which places are
    thinned by shifted conjunctions before stretches are measured, as far as THINNED places.
    """
    n, found = len(x), []
    high = min(high, n // min_exponent + 1) if n >= min_words else 0
    while low < high:
        rows = max(1, min(high - low, BLOCK_CELLS // (n - low + 1)))
        width = n - low + 1  # a place more, so that no stretch goes on in the next row
        own = np.concatenate([x[: n - low], np.array([-2], x.dtype)])
        shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([x[low:], np.full(rows, -1, x.dtype)]), width)[:rows]
        same = (shifted == own).ravel()
        least = min(THINNED, *(max(min_words - q, (min_exponent - 1) * q) for q in range(low, min(low + rows, low + min_words + 1))))
        m = 1  # same[i] says that the m places from i on are equal
        while m < least:
            step = min(m, least - m)
            same = same[: len(same) - step] & same[step:]
            m += step
        at = np.flatnonzero(same)
        if len(at):
            cuts = np.flatnonzero(np.diff(at) != 1)
            first, last = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])]
            lag, length = low + first // width, last - first + m + low + first // width
            long = length >= np.maximum(min_words, min_exponent * lag)
            for s, k, q in zip((first % width)[long].tolist(), length[long].tolist(), lag[long].tolist(), strict=True):
                if not _smaller_period(x, s, s + k, q):
                    found.append((s, k, q))
        low += rows
    return found


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not gone]


def _blank_split(text: str | None) -> list[str]:
    # str.split() without arguments also parts at other white space
    return [w for w in (text or "").translate(_BLANKS).split(" ") if w]


_BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def ranges_of(n: Column, min_exponent: int = MIN_EXPONENT, cells: int = RANGE_CELLS, most: int = MOST_RANGES) -> Column:
    """In how many ranges of lags a text of n words is cut: one for each ``cells`` comparisons."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(n * n / float(min_exponent * cells)))).cast("int")


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT, cells: int = RANGE_CELLS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: a row for each row of ``docs``
    (doc_id, text), checkpointed; other columns are left out.

    A run is a longest stretch of words with smallest period q that has ``min_words`` and ``min_exponent`` * q words at
    least. ``collapsed`` is the text without what any run holds after its first q words, words joined by a blank. A null
    or empty text has no words, no runs and an empty collapsed text; repeated rows have the same result each.

    A text's lags are scanned in place by the task that reads it. A text whose comparisons number more than ``cells``
    is dealt out instead: once for each range of its lags, as many words a range but fewer lags, and its runs come
    together by a key. A text with more runs than fit in a row does not exist, as runs are fewer than words.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats twice at least")
    n = count_words(F.col("text"), BLANK)
    d = docs.select("doc_id", "text", F.when(F.octet_length("text") < (cells**0.5), F.lit(1)).otherwise(ranges_of(n, min_exponent, cells)).alias("ranges"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            out = []
            for text in batch.column("text").to_pylist():
                words = _blank_split(text)
                runs = sorted(runs_of_lags(word_numbers(words), 1, len(words), min_words, min_exponent), key=lambda r: (r[0], r[2]))
                out.append((len(words), runs, " ".join(collapsed(words, runs) if runs else words)))
            yield _batch([batch.column("doc_id")], out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    short = arrow_mapped(d.where("ranges = 1").select("doc_id", "text"), whole, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")
    long = d.where("ranges > 1")
    if long.isEmpty():
        return short

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = _blank_split(batch.column("text")[0].as_py())
            part, parts = batch.column("part")[0].as_py(), batch.column("ranges")[0].as_py()
            lags = len(words) // min_exponent
            runs = runs_of_lags(word_numbers(words), 1 + lags * part // parts, 1 + lags * (part + 1) // parts, min_words, min_exponent)
            columns = [pa.array([r[i] for r in runs], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("digest")[0].as_py()] * len(runs), pa.string()), *columns], ["digest", "start", "length", "period"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = _blank_split(batch.column("text")[0].as_py())
            runs = [(r["start"], r["length"], r["period"]) for r in batch.column("runs")[0].as_py() or []]
            yield _batch([batch.column("doc_id")], [(len(words), runs, " ".join(collapsed(words, runs)))])

    long = long.withColumn("digest", F.sha2("text", 256))
    texts = long.groupBy("digest").agg(F.first("text").alias("text"), F.first("ranges").alias("ranges"))
    parts = texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))
    parts = parts.repartition(F.col("digest"), F.col("part"))
    found = arrow_mapped(parts.select("digest", "text", "ranges", "part"), scanned, "digest string, start int, length int, period int")
    found = found.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    rows = long.select("doc_id", "text", "digest").join(found, "digest", "left").select("doc_id", "text", "runs")
    return checkpointed(short.union(arrow_mapped(rows, joined, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")))


def _batch(key: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
    run = pa.struct([(c, pa.int32()) for c in ("start", "length", "period")])
    runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in row[1]] for row in rows], pa.list_(run))
    columns = [*key, pa.array([r[0] for r in rows], pa.int64()), runs, pa.array([r[2] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: the words joined by a blank; where the CRC-32 of the id ends in 0, the words from one on repeat those of
    a period, both given by the rest of the CRC-32. A null id counts as an empty one."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    tail = h % 10 == 0
    n, g = F.size("words"), F.col("g")
    # a row each; words are made once, below the generator
    d = docs.where(tail).select("doc_id", F.floor(h / 10).cast("long").alias("g"), F.explode(F.array(words_of(F.col("text"), BLANK))).alias("words"))
    d = d.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    d = d.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    period, times = F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    planted = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(period, times))), F.lit(1), n), " ")
    planted = checkpointed(d.select("doc_id", F.when(n > 0, planted).otherwise("").alias("text")))
    return docs.where(~tail).select("doc_id", "text").union(planted)


def run_digests(found: DataFrame) -> DataFrame:
    """From rows of ``periodic_runs``: doc_id, n_runs; start, length, period, exponent_milli of the longest run (the first of
    equal ones, then the one of smallest period; null without a run); runs_sha256, collapsed_sha256, n_words."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    d = found.withColumn("best", best).withColumn("listed", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").cast("long").alias("start"),
        (-F.col("best.minus")).cast("long").alias("length"),
        F.col("best.period").cast("long").alias("period"),
        F.expr("bigint(-1000L * best.minus DIV best.period)").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
