"""Conversation memory, compaction and loop detection over message and tool-call tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import CJK, context_token_estimate

EMPTY_RESULTS = ["", "[]", "{}", "null", "None"]


def snip(messages: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """Messages without repeated system messages and without empty tool results."""
    seen = F.row_number().over(Window.partitionBy(conv, role, text).orderBy(order))
    again = (F.col(role) == "system") & (seen > 1)
    empty = (F.col(role) == "tool") & F.trim(F.coalesce(text, F.lit(""))).isin(EMPTY_RESULTS)
    return messages.withColumn("_again", F.coalesce(again, F.lit(False))).where(~F.col("_again") & ~F.coalesce(empty, F.lit(False))).drop("_again")


def recent_history(messages: DataFrame, conv: str, order: str, role: str, n: int = 4) -> DataFrame:
    """All system messages and the last n user and assistant messages of each conversation."""
    talk = F.col(role).isin("user", "assistant")
    last = messages.where(talk).withColumn("_n", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")
    return last.unionByName(messages.where(F.col(role) == "system"))


def titles(messages: DataFrame, conv: str, order: str, role: str, text: str, chars: int = 20) -> DataFrame:
    """(conv, title): the first user message, cut."""
    first = messages.where(F.col(role) == "user").groupBy(conv).agg(F.min_by(text, order).alias("first"))
    return first.select(conv, F.when(F.length("first") > chars, F.concat(F.substring("first", 1, chars), F.lit("..."))).otherwise(F.col("first")).alias("title"))


def token_budget(messages: DataFrame, conv: str, text: str, window: int = 128_000) -> DataFrame:
    """(conv, tokens, state): which share of the context window is used: leaf .4, micro .6, auto .8, reactive .9."""
    t = messages.groupBy(conv).agg(F.sum(context_token_estimate(F.coalesce(text, F.lit("")))).alias("tokens"))
    state = F.lit("none")
    for share, name in ((0.4, "leaf"), (0.6, "micro"), (0.8, "auto"), (0.9, "reactive")):
        state = F.when(F.col("tokens") > int(window * share), name).otherwise(state)
    return t.select(conv, "tokens", state.alias("state"))


def microcompact(messages: DataFrame, conv: str, order: str, role: str, text: str, kind: str = "tool", keep_blocks: int = 2, chars: int = 300) -> DataFrame:
    """Messages with ``compacted``: those of a role, longer than ``chars``, in runs older than the last few of that role."""
    w = Window.partitionBy(conv).orderBy(order)
    is_kind = F.col(role) == kind
    starts = (is_kind & ~F.coalesce(F.lag(role).over(w) == kind, F.lit(False))).cast("int")
    d = messages.withColumn("_block", F.sum(starts).over(w))
    last = F.max(F.when(is_kind, F.col("_block"))).over(Window.partitionBy(conv))
    old = is_kind & (F.col("_block") <= last - keep_blocks) & (F.length(text) > chars)
    return d.withColumn("compacted", F.coalesce(old, F.lit(False))).drop("_block")


def keep_last(messages: DataFrame, conv: str, order: str, n: int) -> DataFrame:
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def result_importance(text: Column, has_findings: Column) -> Column:
    return F.when(F.trim(text).isin("", "[]", "{}"), "transient").when(has_findings, "critical").when(F.length(text) > 100, "normal").otherwise("transient")


def upsert_memory(memory: DataFrame, new: DataFrame) -> DataFrame:
    """memory (kb_id, memory_type, content, sessions, score) with new rows (same, session instead of sessions) merged.

    Known contents gain the session and 0.1, at most 1; others begin with their own score.
    """
    key = ["kb_id", "memory_type", "content"]
    added = new.groupBy(*key).agg(F.sort_array(F.collect_set("session")).alias("more"), F.max("score").alias("new_score"))
    d = memory.join(added, key, "full_outer")
    none = F.array().cast("array<string>")
    sessions = F.array_union(F.coalesce("sessions", none), F.coalesce("more", none))
    score = F.when(F.col("score").isNull(), F.col("new_score")).when(F.col("new_score").isNull(), F.col("score")).otherwise(F.least(F.lit(1.0), F.col("new_score") + 0.1))
    return d.select(*key, sessions.alias("sessions"), score.alias("score"))


def query_tokens(query: str) -> list[str]:
    """Lower-cased words of two characters and pairs of neighbours with a CJK character; else single CJK characters."""
    wide = lambda c: "一" <= c <= "鿿"
    found = {w.lower() for w in query.split() if len(w) >= 2} | {query[i : i + 2] for i in range(len(query) - 1) if any(map(wide, query[i : i + 2]))}
    return sorted(found or {c for c in query if wide(c)})


def relevant_memories(memory: DataFrame, query: str, key: str, limit: int = 10) -> DataFrame:
    """(key, relevance): the best of the 3 x limit best-scored memories; those without a common token only fill up."""
    terms = query_tokens(query)
    overlap = F.lit(0)
    for t in terms:
        overlap = overlap + F.lower("content").contains(t).cast("int")
    head = memory.orderBy(F.desc("score"), key).limit(limit * 3).withColumn("overlap", overlap)
    w = Window.orderBy(F.desc("score"), key)  # over 3 x limit rows
    # a memory without overlap stays only while fewer than limit // 3 rows were taken before it: hits before it, and
    # other fill-ups, of which there are then as many as come before it
    hits = F.sum((F.col("overlap") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = head.withColumn("hits", F.coalesce(hits, F.lit(0))).withColumn("misses", F.coalesce(F.sum((F.col("overlap") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = d.where((F.col("overlap") > 0) | (F.col("hits") + F.col("misses") < limit // 3))
    relevance = F.when(F.col("overlap") > 0, F.col("score") * (1 + F.col("overlap") * 0.2)).otherwise(F.col("score") * 0.3)
    return kept.select(key, F.round(relevance, 9).alias("relevance")).orderBy(F.desc("relevance"), key).limit(limit)


def information_gain(log: DataFrame, session: str, order: str, item: str, window: int = 5) -> DataFrame:
    """(session, order, gain, saturated): whether each step's item is new, and whether the last ``window`` steps had none."""
    w = Window.partitionBy(session).orderBy(order)
    d = log.withColumn("gain", (F.row_number().over(Window.partitionBy(session, item).orderBy(order)) == 1).cast("int"))
    near = w.rowsBetween(-(window - 1), 0)
    return d.select(session, order, "gain", ((F.count("*").over(near) == window) & (F.sum("gain").over(near) == 0)).alias("saturated"))


def stuck(log: DataFrame, session: str, order: str, tool: str, streak: int = 5, often: int = 5, recent: int = 11) -> DataFrame:
    """(session, order, run_length, in_recent, is_stuck): a tool called too many times in a row or among the last calls."""
    w = Window.partitionBy(session).orderBy(order)
    d = log.withColumn("_new", (~F.coalesce(F.lag(tool).over(w) == F.col(tool), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w)).withColumn("_n", F.row_number().over(w))
    d = d.withColumn("run_length", F.row_number().over(Window.partitionBy(session, "_run").orderBy(order)))
    last = F.collect_list(tool).over(w.rowsBetween(-(recent - 1), 0))
    d = d.withColumn("in_recent", F.size(F.filter(last, lambda x: x == F.col(tool))))
    return d.select(session, order, "run_length", "in_recent", ((F.col("run_length") >= streak) | (F.col("in_recent") >= often)).alias("is_stuck"))


def empty_streaks(log: DataFrame, session: str, order: str, is_empty: Column, n: int = 3) -> DataFrame:
    """Steps at which n results in a row were empty."""
    near = Window.partitionBy(session).orderBy(order).rowsBetween(-(n - 1), 0)
    d = log.withColumn("_e", is_empty.cast("int"))
    return d.withColumn("_s", F.sum("_e").over(near)).where(F.col("_s") == n).select(session, order)


def claim_terms(answer: str, most: int = 5) -> list[str]:
    """The first CJK terms of an answer, or its longer words, each once."""
    import re

    return list(dict.fromkeys(re.findall(f"[{CJK}]{{2,6}}", answer) or re.findall(r"\w{4,}", answer)))[:most]


def claim_check(answer: str, docs: DataFrame, doc: str, text: str, most: int = 5) -> DataFrame:
    """(term, documents, confirmed): terms of an answer, and in how many documents each stands; two confirm it.

    All terms are looked for in one pass. An answer without terms gives no rows.
    """
    terms = claim_terms(answer, most)
    held = F.array_compact(F.array(*[F.when(F.col(text).contains(t), t) for t in terms])) if terms else F.array().cast("array<string>")
    found = docs.select(F.col(doc).alias("_d"), F.explode(held).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n"))
    asked = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return asked.join(found, "term", "left").select("term", n.alias("documents"), (n >= 2).alias("confirmed"))


def repeated_results(log: DataFrame, session: str, order: str, digest: str, least: int = 3) -> DataFrame:
    """Steps (session, order) whose result came before in the session, once more than ``least`` different ones have been seen."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = log.withColumn("_first", (F.row_number().over(Window.partitionBy(session, digest).orderBy(order)) == 1).cast("int"))
    return d.withColumn("_seen", F.coalesce(F.sum("_first").over(w), F.lit(0))).where((F.col("_first") == 0) & (F.col("_seen") > least)).select(session, order)


def emergency_compacted(messages: DataFrame, conv: str, order: str, role: str, text: str, n: int = 6) -> DataFrame:
    """The first system and the first user message and the last n messages of each conversation, each once."""
    first = messages.where(F.col(role).isin("system", "user")).groupBy(conv, role).agg(F.min(order).alias("_o")).select(F.col(conv).alias("_c"), "_o")
    head = messages.join(first, F.col(conv).eqNullSafe(F.col("_c")) & (F.col(order) == F.col("_o")), "left_semi")
    return head.unionByName(keep_last(messages, conv, order, n)).distinct()


def notes_compacted(messages: DataFrame, conv: str, order: str, role: str, text: str, notes: DataFrame, n: int = 8) -> DataFrame:
    """(conv, order, role, text): the first message if it is the system's, the session's notes (conv, text) as a system
    message of order null, and the last n messages. Conversations without notes stay as they are."""
    noted = notes.select(F.col(conv).alias("_c")).distinct()
    same = F.col(conv).eqNullSafe(F.col("_c"))
    m = messages.select(conv, order, role, text)
    plain, long = m.join(noted, same, "left_anti"), m.join(noted, same, "left_semi")
    begin = long.withColumn("_n", F.row_number().over(Window.partitionBy(conv).orderBy(order))).where(F.col("_n") == 1).drop("_n").where(F.col(role) == "system")
    kind = dict(m.dtypes)[order]
    block = notes.select(F.col(conv), F.lit(None).cast(kind).alias(order), F.lit("system").alias(role), F.col(text))
    return plain.unionByName(begin.unionByName(keep_last(long, conv, order, n)).distinct()).unionByName(block)


def cut_results(messages: DataFrame, conv: str, order: str, role: str, text: str, kind: str = "tool", newest: int = 6, chars: int = 2000) -> DataFrame:
    """Messages with results (of role ``kind``) older than the newest few cut to ``chars``; their number does not change."""
    place = F.row_number().over(Window.partitionBy(conv, role).orderBy(F.desc(order)))
    old = (F.col(role) == kind) & (F.col("_n") > newest) & (F.length(text) > chars)
    return messages.withColumn("_n", place).withColumn(text, F.when(old, F.concat(F.substring(text, 1, chars), F.lit("\n[cache_edit截断]"))).otherwise(F.col(text))).drop("_n")


def classified_result(text: Column) -> Column:
    """critical, normal or transient, from what a result holds: names, relations or documents make it critical."""
    from docloom.functions.text import DOCUMENT_KEYS, RELATION_KEYS, json_names, json_values

    found = (F.size(json_names(text)) > 0) | (F.size(json_values(text, RELATION_KEYS)) > 0) | (F.size(json_values(text, DOCUMENT_KEYS)) > 0)
    return result_importance(text, found)


#: Titles of the sections of a session's notes, and the kinds of note that each takes.
NOTE_SECTIONS = [("关键信息", ["finding", "entity"]), ("已完成工作", ["action", "tool_call"]), ("决策与结论", ["decision"]), ("待办事项", ["pending"])]


def session_notes(notes: DataFrame, session: str, order: str) -> DataFrame:
    """(session, text): notes (session, order, topic, summary, entities, importance, type) as Markdown in sections.

    A kind that is missing counts as a finding; an unknown one goes to the first section if critical, else to the second.
    A session's notes are a bounded log.
    """
    critical = F.col("importance") == "critical"
    few = F.slice(F.coalesce("entities", F.array().cast("array<string>")), 1, 5)
    line = F.concat(F.lit("- "), F.when(critical, "[关键]").otherwise("[重要]"), F.lit(" "), "topic", F.lit(": "), "summary", F.when(F.size(few) > 0, F.concat(F.lit(" (相关: "), F.array_join(few, ", "), F.lit(")"))).otherwise(""))
    kind = F.coalesce("type", F.lit("finding"))
    section = F.coalesce(*[F.when(kind.isin(kinds), i) for i, (_, kinds) in enumerate(NOTE_SECTIONS)], F.when(critical, 0).otherwise(1))
    parts = notes.select(session, section.alias("section"), F.struct(F.col(order).alias("o"), line.alias("line")).alias("l")).groupBy(session, "section").agg(F.sort_array(F.collect_list("l")).alias("lines"))
    title = F.element_at(F.lit([t for t, _ in NOTE_SECTIONS]), F.col("section") + 1)
    parts = parts.select(session, F.struct("section", F.concat(F.lit("## "), title, F.lit("\n"), F.array_join("lines.line", "\n")).alias("text")).alias("p"))
    whole = parts.groupBy(session).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return whole.select(session, F.concat(F.lit("<!-- SESSION_MEMORY_START -->\n"), F.array_join("ps.text", "\n\n"), F.lit("\n<!-- SESSION_MEMORY_END -->")).alias("text"))


def evidence_items(text: Column, most: int = 10) -> Column:
    """Numbered or bulleted lines of an answer of more than five characters, without their marks."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[0-9\-•*]"))
    return F.slice(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[0-9.\-) •*]+", ""))), lambda x: F.length(x) > 5), 1, most)


def verdict(supporting: Column, refuting: Column) -> Column:
    """struct<verified, confidence> from how many items speak for and against."""
    score = F.when((supporting > 0) & (refuting == 0), F.least(F.lit(0.95), 0.6 + 0.1 * supporting)).when(supporting > 0, 0.3).otherwise(0.1)
    return F.struct(((supporting > 0) & (refuting == 0)).alias("verified"), score.alias("confidence"))


def converged(confidence: Column, missing: Column, next_query: Column, iteration: Column, every: int = 3) -> Column:
    stop = (confidence >= 0.8) | ((confidence >= 0.6) & (missing == 0)) | (F.coalesce(next_query, F.lit("")) == "")
    return (iteration % every == 0) & stop
