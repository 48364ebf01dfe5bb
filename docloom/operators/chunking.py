"""Splitting texts into chunks of bounded token counts, and tables into batches of rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import heading
from docloom.operators.ordering import numbered

LEAST, MOST, OVERLAP = 500, 1000, 100
_WIDE = re.compile("[\u2e81-\U0010ffff]+")
_SENTENCE = re.compile(r"(?<=[。！？.!?])\s*")


def measure(text: str) -> tuple[int, int, str, str]:
    """Wide characters, words of the rest, and the rest's first and last character."""
    rest = text if text.isascii() else _WIDE.sub("", text)
    return len(text) - len(rest), len(rest.split()), rest[:1], rest[-1:]


def both(a: tuple, b: tuple) -> tuple:
    """The measure of two texts end to end: where no blank parts them, two words become one."""
    joined = bool(a[3]) and bool(b[2]) and not a[3].isspace() and not b[2].isspace()
    return a[0] + b[0], a[1] + b[1] - joined, a[2] or b[2], b[3] or a[3]


def tokens_of(m: tuple) -> int:
    return int(1.5 * m[0] + 1.3 * m[1])


def estimate(text: str) -> int:
    return tokens_of(measure(text))


def sentences(text: str, most: int) -> list[str]:
    """Whole sentences packed up to ``most`` tokens; a longer sentence is cut between characters."""
    out: list[str] = []
    held, size = "", measure("")
    for s in filter(None, _SENTENCE.split(text)):
        pieces = [s] if estimate(s) <= most else list(s)
        if len(pieces) > 1 and held:
            out.append(held)
            held, size = "", measure("")
        for piece in pieces:
            own = measure(piece)
            if held and tokens_of(both(size, own)) > most:
                out.append(held)
                held, size = piece, own
            else:
                held, size = held + piece, both(size, own)
        if len(pieces) > 1:
            out.append(held)
            held, size = "", measure("")
    return [*out, held] if held else out


def segments(text: str, least: int = LEAST, most: int = MOST, paragraph: str = "\n\n") -> list[str]:
    """Paragraphs, short ones joined to those that follow until they have ``least`` tokens, long ones cut by sentence."""
    parts = [p.strip() for p in text.split(paragraph) if p.strip()]
    out, i = [], 0
    while i < len(parts):
        n = estimate(parts[i])
        if n < least:
            held = [parts[i]]
            while i + 1 < len(parts) and n < least:
                i += 1
                held.append(parts[i])
                n += estimate(parts[i])
            out.append(paragraph.join(held))
        elif n > most:
            out += sentences(parts[i], most)
        else:
            out.append(parts[i])
        i += 1
    return out


def tail(text: str, n: int) -> str:
    """The last words that make up about n estimated tokens, at least one."""
    words = text.split()
    return " ".join(words[-max(1, int(len(words) * n / max(1, estimate(text)))) :]) if words else ""


def chunk(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, most: int = MOST, overlap: int = OVERLAP, paragraph: str = "\n\n") -> DataFrame:
    """(doc, chunk_no, chunk_id, content, is_overlap): segments in order, each with the end of the one before it.

    Cutting is a fold over a text and runs on one document at a time inside Arrow batches, where the segment before is at
    hand, so nothing is shuffled. The last ``overlap`` tokens of the segment before, if it has more, come first in a chunk,
    with a paragraph's break between. Null and empty texts have no chunks; repeated rows each have their own.
    """
    names = [doc, "chunk_no", "content", "is_overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = segments(t or "", least, most, paragraph)
                again = [False, *(estimate(s) > overlap for s in own[:-1])][: len(own)]
                content = [f"{tail(own[i - 1], overlap)}\n\n{s}" if x else s for i, (s, x) in enumerate(zip(own, again, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), batch.column(0).type), pa.array(range(1, len(own) + 1), pa.int64()), pa.array(content, pa.string()), pa.array(again, pa.bool_())], names)

    kind = dict(docs.dtypes)[doc]
    parts = docs.select(doc, text).mapInArrow(run, f"{doc} {kind}, chunk_no long, content string, is_overlap boolean")
    name = F.format_string("%s_chunk_%03d", F.col(doc).cast("string"), F.col("chunk_no"))
    return parts.select(doc, "chunk_no", name.alias("chunk_id"), "content", "is_overlap")


def row_batches(rows: DataFrame, group: str, order: str, cells: list[str], size: int = 50, banner: str | None = None) -> DataFrame:
    """(group, batch, n_rows, content): rows in batches that never cross groups, the header repeated in each; a banner (a
    column) stands in front of the first batch of its group."""
    placed = numbered(rows, [group], [order], "_n").withColumn("_n", F.col("_n") - 1).withColumn("batch", F.floor(F.col("_n") / size))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cells]), F.lit(" |"))
    header = "| " + " | ".join(cells) + " |\n|" + "---|" * len(cells)
    above = F.max(F.col(banner)) if banner else F.max(F.lit(None).cast("string"))
    parts = placed.groupBy(group, "batch").agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_list(F.struct("_n", line.alias("line")))).alias("lines"), above.alias("_banner"))
    first = F.when((F.col("batch") == 0) & F.col("_banner").isNotNull(), F.concat("_banner", F.lit("\n\n"))).otherwise("")
    return parts.select(group, "batch", "n_rows", F.concat(first, F.lit(header + "\n"), F.array_join("lines.line", "\n")).alias("content"))


def overlap_length(before: Column, after: Column, least: int = 6, most: int = 500, tries: int = 3) -> Column:
    """The longest end of one text that begins the other, between two bounds; 0 if there is none.

    Such an end begins where the other text's first ``least`` characters stand. These places are looked at from the longest
    end on; only where the first few do not do are all shorter ends compared.
    """
    top = F.least(F.length(before), F.length(after), F.lit(most))
    head = F.substring(after, 1, least)

    def shorter(p: Column) -> Column:
        sizes = F.when(F.length(before) - p >= least, F.sequence(F.lit(least), F.length(before) - p)).otherwise(F.array().cast("array<int>"))
        return F.array_max(F.filter(sizes, lambda n: F.startswith(after, F.right(before, n))))

    def end_at(p: Column, left: int) -> Column:
        rest = end_at(F.call_function("locate", head, before, p + 1), left - 1) if left else shorter(p)
        return F.when(p > 0, F.when(F.startswith(after, F.substring(before, p, F.length(before))), F.length(before) - p + 1).otherwise(rest))

    first = F.call_function("locate", head, before, F.length(before) - top + 1)
    return F.coalesce(F.when(top >= least, end_at(first, tries - 1)), F.lit(0))


def pieces(docs: DataFrame, doc: str, text: str, step: int, size: int) -> DataFrame:
    """(doc, piece, body): a text's characters from ``piece`` on, counted from 1, ``size`` of them every ``step``, of which
    ``size`` is at most twice as many. A text is read once from left to right; null and empty ones have no pieces."""
    d = docs.select(F.col(doc), F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), 0).alias("_p"))
    bodies = F.transform("_p", lambda x, i: F.concat(x, F.substring(F.coalesce(F.get("_p", i + 1), F.lit("")), 1, size - step)))
    d = d.select(doc, F.posexplode(bodies).alias("_i", "body"))
    return d.select(doc, (F.col("_i") * step + 1).alias("piece"), "body")


def merged(chunks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Chunks with what they repeat of the one before them taken off."""
    w = Window.partitionBy(doc).orderBy(order)
    d = chunks.withColumn("_before", F.coalesce(F.lag(text).over(w), F.lit("")))
    n = overlap_length(F.col("_before"), F.col(text))
    return d.select(doc, order, n.alias("overlap"), F.substring(F.col(text), n + 1, F.length(text)).alias("fresh"))


def strip_header(text: Column) -> Column:
    """What follows the first ``---`` line of a stored chunk; all of it if there is none."""
    return F.when(text.contains("\n---\n"), F.regexp_replace(text, r"(?s)^.*?\n---\n", "")).otherwise(text)


def with_header(chunk_id: Column, doc_id: Column, n: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), chunk_id, F.lit("\n**Doc:** "), doc_id, F.lit("\n**Token Count:** "), n.cast("string"), F.lit("\n---\n"), body)


def chapters(chunks: DataFrame, doc: str, order: str, text: str, pattern: str | None = None, chars: int = 2048, size: int = 100) -> DataFrame:
    """(doc, name, first, last): chapters begin at chunks with a heading near the top and end before the next one.

    Documents without a heading get ranges of ``size`` chunks.
    """
    found = heading(F.substring(text, 1, chars), pattern) if pattern else heading(F.substring(text, 1, chars))
    d = chunks.select(doc, F.col(order).alias("at"), found.alias("name"))
    ends = d.groupBy(doc).agg(F.max("at").alias("end"), F.min("at").alias("begin"), F.count("name").alias("named"))
    w = Window.partitionBy(doc).orderBy("at")
    named = d.where("name IS NOT NULL").withColumn("next", F.lead("at").over(w)).join(ends.select(doc, "end"), doc)
    named = named.select(doc, "name", F.col("at").alias("first"), F.coalesce(F.col("next") - 1, F.col("end")).alias("last"))
    plain = ends.where("named = 0").select(doc, "end", F.explode(F.sequence("begin", "end", F.lit(size))).alias("first"))
    last = F.least(F.col("first") + size - 1, F.col("end"))
    return named.unionByName(plain.select(doc, F.concat(F.lit("#"), "first", F.lit(" - #"), last).alias("name"), "first", last.alias("last")))
