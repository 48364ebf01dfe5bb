"""Full-text search, line search and reading of documents."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.operators.ordering import checkpointed, removed, small_or_shuffled

#: Postings that a task sorts, about.
TASK_POSTINGS = 1_000_000


def postings(chunks: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc, tf): the inverted index, a derived table that is written once and clustered by term."""
    words = chunks.select(F.col(doc), F.explode_outer(tokens(F.col(text))).alias("term")).where("term IS NOT NULL")
    return words.groupBy("term", doc).agg(F.count("*").alias("tf"))


def document_lengths(chunks: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens), the other half of the index."""
    return chunks.select(F.col(doc), F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("n_tokens"))


def once(chunks: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text): each document once, of rows with one id the one with the largest text. Ids alone are shuffled, and
    texts only where their id comes twice."""
    rows, again = chunks.select(doc, text), F.col(doc).eqNullSafe(F.col("_twice"))
    twice = checkpointed(rows.groupBy(F.col(doc).alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1").select("_twice"))
    if twice.isEmpty():
        return rows
    twice = small_or_shuffled(twice)
    largest = rows.join(twice, again, "left_semi").groupBy(doc).agg(F.max(text).alias(text))
    return rows.join(twice, again, "left_anti").unionByName(largest)


def counted_terms(chunks: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, terms: array of (term, tf) by term) of each row, all within the row: its tokens are sorted, and a
    term's count is the distance to where the next one begins. No task holds more than a row's tokens."""
    d = chunks.select(F.col(doc), F.sort_array(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))).alias("_w"))
    n = F.size("_w")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    d = d.select(doc, "_w", F.filter(places, lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1))).alias("_at"))
    tf = lambda i, k: F.coalesce(F.get("_at", k + 1), F.size("_w")) - i
    terms = F.transform("_at", lambda i, k: F.struct(F.get("_w", i).alias("term"), tf(i, k).cast("long").alias("tf")))
    return d.select(doc, F.size("_w").alias("n_tokens"), terms.alias("terms"))


def postings_of(counted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(term, doc, tf) of what ``counted_terms`` gives."""
    return counted.select(doc, F.explode("terms").alias("_t")).select("_t.term", doc, "_t.tf")


def n_postings(counted: DataFrame) -> int:
    return counted.agg(F.sum(F.size("terms"))).first()[0] or 0


def write_sorted(rows: DataFrame, most: int, out: str, doc: str = "doc_id") -> None:
    """Postings, ``most`` or fewer, sorted by term and document. A task sorts about ``TASK_POSTINGS`` of them, however many there are."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // TASK_POSTINGS))
    rows.repartitionByRange(parts, "term", doc).sortWithinPartitions("term", doc).write.mode("overwrite").parquet(out)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The different tokens of a query, sorted."""
    return sorted({r[0] for r in spark.range(1).select(F.explode(tokens(F.lit(query)))).collect()})


def _ranked(hits: DataFrame, counts: list[str], totals: Row, doc: str, k: int, k1: float, b: float) -> DataFrame:
    """The k best of rows (doc, n_tokens, counts of each term), all of which are above 0."""
    score = F.lit(0.0)
    for i, c in enumerate(counts):
        n = totals[f"n{i}"]
        idf = max(1e-6, math.log((totals["n_all"] - n + 0.5) / (n + 0.5)))
        tf = F.col(c)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_tokens") / F.lit(totals["avg_tokens"])))
    return hits.select(doc, (-score).alias("rank")).orderBy(F.round("rank", 9), doc).limit(k)


def bm25(chunks: DataFrame, query: str, k: int, doc: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, rank) of the k best documents that hold every token of the query; rank is the negated BM25 score.

    idf is ``ln((N - n + 0.5) / (n + 0.5))``, at least 1e-6. One pass takes each text apart once and keeps, in a
    checkpoint, the number of its tokens and of each of the query's; the sums that the driver needs are a row, and the rows
    that hold all tokens are scored without a shuffle of words. Ties go by document. A query without tokens finds
    nothing. Where many questions are asked of one corpus, ``bm25_of_index`` reads a written index instead.
    """
    terms = query_terms(chunks.sparkSession, query)
    if not terms:
        return chunks.select(doc, F.lit(0.0).alias("rank")).limit(0)
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    d = chunks.select(F.col(doc), split.alias("_w"))
    names = [f"_c{i}" for i in range(len(terms))]
    own = [(F.size("_w") - F.size(F.array_remove("_w", t))).alias(c) for c, t in zip(names, terms, strict=True)]
    d = checkpointed(d.select(F.col(doc), F.size(F.array_remove("_w", "")).alias("n_tokens"), *own))
    totals = d.agg(F.count("*").alias("n_all"), F.avg("n_tokens").alias("avg_tokens"), *[F.count_if(F.col(c) > 0).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return _ranked(d.where(reduce(Column.__and__, [F.col(c) > 0 for c in names])), names, totals, doc, k, k1, b)


def write_index(chunks: DataFrame, out: str, doc: str = "doc_id", text: str = "text") -> None:
    """The inverted index as two tables below ``out``: postings sorted by term, so that a search reads few row groups, and
    lengths. Written anew each time, so chunks that come twice are in it once. Texts are taken apart once, into a table
    that is there until both are written."""
    spark = chunks.sparkSession
    counted_terms(once(chunks, doc, text), doc, text).write.mode("overwrite").parquet(f"{out}/counted")
    counted = spark.read.parquet(f"{out}/counted")
    write_sorted(postings_of(counted, doc), n_postings(counted), f"{out}/postings", doc)
    counted.select(doc, "n_tokens").write.mode("overwrite").parquet(f"{out}/lengths")
    removed(spark, f"{out}/counted")


def bm25_of_index(spark: SparkSession, index: str, query: str, k: int, doc: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """As ``bm25``, from a written index: the query's terms are pushed down to the postings' scan."""
    terms = query_terms(spark, query)
    mine, lengths = spark.read.parquet(f"{index}/postings").where(F.col("term").isin(terms)), spark.read.parquet(f"{index}/lengths")
    names = [f"_c{i}" for i in range(len(terms))]
    own = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(c) for c, t in zip(names, terms, strict=True)]
    hits = checkpointed(mine.groupBy(doc).agg(F.count("*").alias("_terms"), *own))
    sizes = lengths.agg(F.count("*").alias("n_all"), F.avg("n_tokens").alias("avg_tokens")).first()
    found = hits.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(names)]).first() if terms else Row()
    totals = Row(**sizes.asDict(), **found.asDict()) if terms else sizes
    whole = hits.where(F.col("_terms") == len(terms)).join(lengths, doc)
    return _ranked(whole, names, totals, doc, k, k1, b)


def any_word(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Rows that hold at least one of up to eight words as a substring, case ignored."""
    return docs.where(reduce(Column.__or__, [F.lower(text).contains(w.lower()) for w in words[:8]], F.lit(False)))


def all_words(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows that hold every blank-separated word of the query, case ignored, with a ``snippet`` of 300 characters that
    begins 100 before the first word, marked where it is cut."""
    words = query.lower().split()
    lower = F.lower(text)
    at = F.instr(lower, words[0]) - 1 if words else F.lit(0)
    start = F.greatest(F.lit(0), at - 100)
    cut = F.substring(F.col(text), start + 1, F.lit(300))
    snippet = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(start + 300 < F.length(text), "...").otherwise(""))
    return docs.where(reduce(Column.__and__, [lower.contains(w) for w in words], F.lit(bool(words)))).withColumn("snippet", snippet)


def lines_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no from 1, line)."""
    return docs.select(F.col(doc), F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line")).where("line IS NOT NULL").withColumn("line_no", F.col("line_no") + 1)


def grep(docs: DataFrame, pattern: str, doc: str = "doc_id", text: str = "text", around: int = 80) -> DataFrame:
    """(doc, line_no, match, context): the first match of each line, with characters on either side, cut ends marked."""
    hit = lines_of(docs, doc, text).where(F.col("line").rlike(f"(?i){pattern}"))
    match = F.regexp_extract("line", f"(?i){pattern}", 0)
    at = F.length(F.get(F.split("line", f"(?i){pattern}", 2), F.lit(0)))
    start, end = F.greatest(F.lit(0), at - around), at + F.length(match) + around
    context = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(F.col("line"), start + 1, end - start), F.when(end < F.length("line"), "...").otherwise(""))
    return hit.select(doc, "line_no", match.alias("match"), context.alias("context"))


def grep_with_lines(docs: DataFrame, pattern: str, lines_around: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line of 300 characters, before, after): matching lines with neighbours of 200 characters each."""
    d = docs.select(F.col(doc), F.split(text, "\n").alias("lines")).select(doc, "lines", F.posexplode_outer("lines").alias("i", "line"))
    d = d.where(F.col("line").rlike(f"(?i){pattern}"))
    low = F.greatest(F.lit(0), F.col("i") - lines_around)

    def short(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda x: F.substring(x, 1, 200)), "\n")

    return d.select(doc, (F.col("i") + 1).alias("line_no"), F.substring("line", 1, 300).alias("line"), short(F.slice("lines", low + 1, F.col("i") - low)).alias("before"), short(F.slice("lines", F.col("i") + 2, F.lit(lines_around))).alias("after"))


def grep_page(docs: DataFrame, pattern: str, lines_around: int, offset: int, limit: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A page of ``grep_with_lines`` by document and line, each row with ``total``, the number of matching lines of all
    documents. Texts are searched once: what is counted, sorted and paged are the short rows of the matches. A page beyond
    the last row is empty."""
    hits = checkpointed(grep_with_lines(docs, pattern, lines_around, doc, text))
    return page_rows(hits, [F.col(doc), F.col("line_no"), F.col("line")], offset, limit)


def files_with_matches(docs: DataFrame, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in which a line matches, once each."""
    lines = F.split(text, "\n")
    return docs.where(F.exists(lines, lambda x: x.rlike(f"(?i){pattern}"))).select(doc).distinct()


def read_lines(docs: DataFrame, start: int, n: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, total_lines, text) of n lines, at most 500, from line ``start`` on, counted from 1."""
    lines = F.split(text, "\n")
    return docs.select(doc, F.size(lines).alias("total_lines"), F.array_join(F.slice(lines, max(1, start), min(n, 500)), "\n").alias("text"))


def neighbours(chunks: DataFrame, group: str, order: str, text: str, chars: int = 100) -> DataFrame:
    """Every chunk with the first characters of the one before and after it in its document."""
    w = Window.partitionBy(group).orderBy(order)
    return chunks.select(group, order, F.substring(F.lag(text).over(w), 1, chars).alias("previous"), F.substring(F.lead(text).over(w), 1, chars).alias("next"))


def entity_score(name: Column, kind: Column, description: Column, query: str) -> Column:
    """3 for a keyword in the name, 1 in the description, 2 in the type; 5 and 2 for the whole query in name or description."""
    q = query.lower()
    parts = [F.lit(0)]
    for w in q.split():
        parts += [F.when(F.lower(name).contains(w), 3).otherwise(0), F.when(F.lower(description).contains(w), 1).otherwise(0), F.when(F.lower(kind).contains(w), 2).otherwise(0)]
    parts += [F.when(F.lower(name).contains(q), 5).otherwise(0), F.when(F.lower(description).contains(q), 2).otherwise(0)]
    return reduce(Column.__add__, parts)


def page_rows(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of ordered rows, each with ``total``, the number of all rows; the sort keeps only offset + limit rows of
    each partition."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row
