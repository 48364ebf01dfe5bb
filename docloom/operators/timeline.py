"""Timelines from texts and summaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import TITLE_ARTIFACTS, TITLE_PATTERNS, bound, full_day, relative_date, relative_days, timeline_dates
from docloom.operators.linking import named_in
from docloom.operators.ordering import checkpointed, numbered, with_previous


def event_title(text: Column, chars: int = 50) -> Column:
    """The first action phrase of 5 to 50 characters; else the text's beginning, cut at a blank.

    What stands before the marks of a stored chunk's header is left out, if over ten characters follow.
    """

    def without_header(t: Column, mark: Column) -> Column:
        after = F.regexp_replace(F.substring(t, F.instr(t, mark) + F.length(mark), F.length(t)), r"^\s+|\s+$", "")
        return F.when(t.contains(mark) & (F.length(after) > 10), after).otherwise(t)

    def titled(clean: Column) -> Column:
        tried = []
        for p in TITLE_PATTERNS:
            words = [clean.rlike(w) for w in re.findall(r"\(\?:([^)]*)\)", p)]  # a match holds one of each of these; without them the search is square
            found = F.trim(F.regexp_replace(F.regexp_extract(clean, p, 1), r"\*{1,3}|\bToken\s*Count\b|Is\s*Overlap", ""))
            tried.append(F.when(reduce(Column.__and__, words), bound(found, lambda t: F.when((F.length(t) >= 5) & (F.length(t) <= chars), t))))
        return F.coalesce(*tried, shortened(clean))

    def shortened(clean: Column) -> Column:
        flat = F.regexp_replace(F.trim(F.replace(clean, F.lit("\n"), F.lit(" "))), r"\*{1,3}\s*(Token Count|Is Overlap)[^*]+\*{1,3}", "")
        flat = F.regexp_replace(flat, r"\s{2,}", " ")
        head = F.substring(flat, 1, chars)
        return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head), F.lit("...")))

    clean = F.aggregate(F.lit(TITLE_ARTIFACTS), text, without_header)
    title = bound(clean, titled)
    return F.when(F.coalesce(text, F.lit("")) == "", "未知事件").otherwise(title)


def dated_contexts(chunks: DataFrame, keep: list[str], text: str, around: int = 100) -> DataFrame:
    """(keep, place, date, context): every date in the texts, its place in the order of finding, and the characters on
    either side of its beginning, on one line."""
    d = chunks.select(*keep, F.col(text).alias("_t"), F.posexplode_outer(timeline_dates(F.col(text))).alias("place", "_d")).where("_d IS NOT NULL")
    low = F.greatest(F.lit(0), F.col("_d.start") - around)
    cut = F.substring(F.col("_t"), low + 1, F.col("_d.start") + around - low)
    return d.select(*keep, "place", F.col("_d.date").alias("date"), F.regexp_replace(F.replace(cut, F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "").alias("context"))


def _first_of(events: DataFrame, chars: int) -> DataFrame:
    """Events (kb_id, date, context, seq, ...), the first in order of each date and first ``chars`` characters of context."""
    fields = [c for c in events.columns if c not in ("kb_id", "date", "seq")]
    g = events.groupBy("kb_id", "date", F.substring("context", 1, chars).alias("_head")).agg(F.min(F.struct("seq", *fields)).alias("e"))
    return g.select("kb_id", "date", "e.*")


def build(chunks: DataFrame, entities: DataFrame, summaries: DataFrame) -> DataFrame:
    """(kb_id, date, title, description, participants, source_docs, source_chunks, confidence, inferred_from).

    ``chunks`` (kb_id, doc_id, chunk_id, seq, text), ``entities`` (kb_id, id, name), ``summaries`` (kb_id, seq, summary,
    chunk_ids, names). Every date in a chunk is an event of confidence .6 with 100 characters on either side, and the
    first five entities, by id, whose names stand there. Every date in a summary is one of .8, with the entities that it
    names. One event stays for each date and first 60 characters. Events are put in order of date; one whose description
    holds a relative date is moved to it, counted from the earliest of the three events before it that has a full date,
    at .2 less confidence, .5 at least. Bases are the dates as found, not as moved. Events of one date and first 50
    characters become one, with all their participants and documents and the largest confidence.

    Names are found in contexts by ``named_in``; order comes from range partitions, so a knowledge base that holds
    a third of all rows never meets in one task.
    """
    none = F.array().cast("array<string>")
    found = dated_contexts(chunks, ["kb_id", "doc_id", "chunk_id", "seq"], "text")
    found = found.select("kb_id", "date", F.struct(F.lit(0).alias("phase"), F.col("seq").alias("at"), "place").alias("seq"), "context", F.array("doc_id").cast("array<string>").alias("source_docs"), F.array("chunk_id").cast("array<string>").alias("source_chunks"), F.lit(0.6).alias("confidence"), none.alias("names"))
    s = summaries.select("kb_id", F.col("summary").alias("context"), F.col("chunk_ids").cast("array<string>").alias("chunk_ids"), F.col("names").cast("array<string>").alias("names"), F.col("seq").alias("at"), F.posexplode_outer(timeline_dates(F.col("summary"))).alias("place", "d")).where("d IS NOT NULL")
    s = s.select("kb_id", F.col("d.date").alias("date"), F.struct(F.lit(1).alias("phase"), "at", "place").alias("seq"), "context", none.alias("source_docs"), F.slice(F.coalesce("chunk_ids", none), 1, 3).alias("source_chunks"), F.lit(0.8).alias("confidence"), F.coalesce("names", none).alias("names"))
    events = checkpointed(_first_of(found.unionByName(s), 60))

    people = entities.select(F.col("kb_id").alias("_kb"), F.col("id").cast("string").alias("_id"), F.col("name").alias("_name"))
    texts = events.where("seq.phase = 0").select("context").distinct()
    inside = named_in(texts, "context", "context", people, "_name").select(F.col("context").alias("_context"), F.col("name").alias("_n"))
    mentioned = events.where("seq.phase = 0").join(inside, F.col("context") == F.col("_context")).select("kb_id", "date", "seq", "_n")
    listed = events.where("seq.phase = 1").select("kb_id", "date", "seq", F.explode("names").alias("_n"))
    linked = mentioned.unionByName(listed).join(people, F.col("kb_id").eqNullSafe(F.col("_kb")) & (F.col("_n") == F.col("_name")))
    linked = linked.groupBy(F.col("kb_id").alias("_k"), F.col("date").alias("_d"), F.col("seq").alias("_s")).agg(F.slice(F.sort_array(F.collect_set(F.struct("_id", "_name"))), 1, 5).alias("_people"))
    same = F.col("kb_id").eqNullSafe(F.col("_k")) & (F.col("date") == F.col("_d")) & (F.col("seq") == F.col("_s"))
    events = events.join(linked, same, "left").select("kb_id", "date", "seq", "context", F.substring("context", 1, 200).alias("description"), F.coalesce(F.col("_people._name"), none).alias("participants"), "source_docs", "source_chunks", "confidence")

    ordered = numbered(events, ["kb_id"], ["date", "seq"], "n")
    ordered = with_previous(ordered, ["kb_id"], "n", ["date"], 3)
    ordered = ordered.withColumn("_days", relative_days(F.col("description")))
    days = [F.when(F.col("_days").isNotNull(), full_day(F.col(f"date_{k}"))).alias(f"_day_{k}") for k in (3, 2, 1)]  # most events have no relative date
    ordered = ordered.select("*", *days)
    base = F.coalesce(*[F.when(F.col(f"_day_{k}").isNotNull(), F.col(f"date_{k}")) for k in (3, 2, 1)])
    moved = F.date_format(F.date_add(F.coalesce("_day_3", "_day_2", "_day_1"), F.col("_days")), "yyyy-MM-dd")
    ordered = ordered.select("*", moved.alias("resolved"), base.alias("inferred_from"))
    ordered = ordered.withColumn("confidence", F.when(F.col("resolved").isNotNull(), F.greatest(F.lit(0.5), F.round(F.col("confidence") - 0.2, 9))).otherwise(F.col("confidence"))).withColumn("date", F.coalesce("resolved", "date"))
    merged = ordered.groupBy("kb_id", "date", F.substring("description", 1, 50).alias("_head")).agg(
        F.min(F.struct("n", "context", "description", "source_chunks", "inferred_from")).alias("e"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", "participants"))), lambda x: x["participants"])).alias("participants"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", "source_docs"))), lambda x: x["source_docs"])).alias("source_docs"),
        F.max("confidence").alias("confidence"),
    )
    return merged.select("kb_id", "date", event_title(F.col("e.context")).alias("title"), F.col("e.description").alias("description"), "participants", "source_docs", F.col("e.source_chunks").alias("source_chunks"), "confidence", F.col("e.inferred_from").alias("inferred_from"))


def best_per_date(events: DataFrame, date: str, text: str, order: str) -> DataFrame:
    """The event with the longest description of each date, the first in order among equals."""
    w = Window.partitionBy(date).orderBy(F.desc(F.length(text)), order)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_relative(events: DataFrame, group: str, order: str, date: str, text: str) -> DataFrame:
    """Events with ``resolved``: their own date, or the nearest of the three before them moved by a relative expression."""
    w = Window.partitionBy(group).orderBy(order)
    found = F.coalesce(*[relative_date(F.lag(date, i).over(w), F.col(text)) for i in (1, 2, 3)])
    return events.withColumn("resolved", F.coalesce(F.col(date), found))


def out_of_order(events: DataFrame, group: str, order: str, date: str) -> DataFrame:
    """Events dated before the one that precedes them in the source."""
    return events.withColumn("previous", F.lag(date).over(Window.partitionBy(group).orderBy(order))).where(F.col(date) < F.col("previous"))


def between(events: DataFrame, date: str, start: str | None, end: str | None, people: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    """Events of a range, dates compared as text so that partial dates take part, and of given participants."""
    d = events
    if start:
        d = d.where(F.col(date) >= start)
    if end:
        d = d.where(F.col(date) <= end)
    if wanted and people:
        d = d.where(F.arrays_overlap(people, F.array(*[F.lit(x) for x in wanted])))
    return d
