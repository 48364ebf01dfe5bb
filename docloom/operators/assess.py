"""Checks of a compiled knowledge base, its documents and its sessions."""

from __future__ import annotations

from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import contains_any
from docloom.operators.ordering import checkpointed, small_or_shuffled

# ---- fixed values: words that choose a page's template, tried in this order; the first group only in technical domains.
TECHNICAL_TEMPLATES = [
    ("method", ["方法", "模型", "算法", "框架", "架构", "method", "model", "algorithm", "framework"]),
    ("concept", ["概念", "定义", "原理", "concept", "definition"]),
    ("method", ["实验", "结果", "评估", "experiment", "result", "evaluation"]),
]
TEMPLATES = [
    ("evidence", ["证据", "物证", "书证", "证词", "口供", "笔录"]),
    ("event", ["事件", "经过", "案发", "时间线"]),
    ("person", ["人物", "嫌疑人", "被害人", "被告", "原告", "证人"]),
]
# ----


def quality_issues(counts: DataFrame) -> DataFrame:
    """Rows (entities, relations, events, graph_nodes, batches, ...) with ``issues`` and ``status``."""
    e, r, t, g, b = (F.coalesce(F.col(c), F.lit(0)) for c in ("entities", "relations", "events", "graph_nodes", "batches"))
    tests = [
        ("no_entities", e == 0),
        ("too_few_entities", (e > 0) & (e < 2) & (b > 5)),
        ("too_many_entities", e > b * 50),
        ("empty_timeline", (t == 0) & (b > 3)),
        ("no_relations", (r == 0) & (e > 1)),
        ("empty_event_graph", (g == 0) & (b > 3)),
    ]
    issues = F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    return counts.withColumn("issues", issues).withColumn("status", F.when(F.size("issues") == 0, "pass").otherwise("needs_review"))


def domains(entities: DataFrame) -> DataFrame:
    """(kb_id, domain): legal if there is evidence or a document, or if people and organizations are no fewer than
    concepts, methods and models; else general. Only the five most frequent types count."""
    kinds = entities.groupBy("kb_id", "type").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("_r", F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("n"), "type"))).where("_r <= 5")

    def total(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type").isin(*names), F.col("n"))), F.lit(0))

    people = total("person", "organization")
    legal = (total("evidence", "document") > 0) | ((people > 0) & (people >= total("concept", "method", "model")))
    return kinds.groupBy("kb_id").agg(F.when(legal, "legal").otherwise("general").alias("domain"))


def template_type(title: Column, description: Column, technical: bool = False) -> Column:
    t = F.lower(F.concat(title, F.coalesce(description, F.lit(""))))
    out = F.when(F.lit(False), "")
    for name, words in (TECHNICAL_TEMPLATES if technical else []) + TEMPLATES:
        out = out.when(contains_any(t, words), name)
    return out.otherwise("default")


def surprises(mentions: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """(kind, score, subject) of four kinds of surprise in one knowledge base.

    ``mentions`` (name, doc): names in one document only, where names are in more than two on average. ``entities``
    (name, type, attributes map): those with attributes that are in two documents or more, and a type that holds over
    80 % of more than ten entities of three types or more. ``events`` (seq, date, title): dated before the dated event
    that precedes them in the source.
    """
    docs = mentions.where("name != ''").select("name", "doc").distinct().groupBy("name").agg(F.count("*").alias("docs"))
    mean = docs.agg(F.avg("docs").alias("mean"))
    alone = docs.where("docs <= 1").join(F.broadcast(mean), F.col("mean") > 2).select(F.lit("isolated_entity").alias("kind"), F.lit(0.7).alias("score"), F.col("name").alias("subject"))  # one row
    described = entities.where(F.size("attributes") > 0).select("name").distinct()
    across = docs.where("docs >= 2").join(described, "name", "left_semi").select(F.lit("cross_doc_contradiction").alias("kind"), F.lit(0.75).alias("score"), F.col("name").alias("subject"))
    # each event against the one before it, in two levels, so that no task holds the whole source
    dated = events.where("date IS NOT NULL AND date != ''").select("seq", "date", F.substring("title", 1, 50).alias("subject"), F.floor(F.col("seq") / 10_000).alias("block"))
    within = dated.withColumn("previous", F.lag("date").over(Window.partitionBy("block").orderBy("seq")))
    ends = dated.groupBy("block").agg(F.max_by("date", "seq").alias("end"))
    ends = ends.select("block", F.lag("end").over(Window.orderBy("block")).alias("end"))  # a row for each block
    back = within.join(ends, "block").where("date < coalesce(previous, end)").select(F.lit("temporal_anomaly").alias("kind"), F.lit(0.85).alias("score"), "subject")
    kinds = entities.groupBy(F.coalesce("type", F.lit("unknown")).alias("subject")).agg(F.count("*").alias("n"))
    every = kinds.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    skewed = kinds.join(F.broadcast(every), (F.col("total") > 10) & (F.col("kinds") > 2) & (F.col("n") > 0.8 * F.col("total"))).select(F.lit("skewed_distribution").alias("kind"), F.lit(0.5).alias("score"), "subject")
    return alone.unionByName(across).unionByName(back).unionByName(skewed)


def synthesis(found: DataFrame, most: int = 20) -> DataFrame:
    """(session, entity, sources, kept, conflict) from rows (session, task, seq, entity, finding) of tasks that succeeded.

    Entities found by more than one task are kept; where a session has none, its first ``most`` are. More than one
    different finding about an entity is a conflict.
    """
    g = found.groupBy("session", "entity").agg(F.countDistinct("task").alias("sources"), F.countDistinct(F.xxhash64("finding")).alias("findings"), F.min("seq").alias("first"))
    shared = g.groupBy("session").agg(F.max("sources").alias("best"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("first", "entity"))
    d = g.withColumn("place", place).join(shared, "session")
    kept = (F.col("sources") > 1) | ((F.col("best") <= 1) & (F.col("place") <= most))
    return d.select("session", "entity", "sources", kept.alias("kept"), (F.col("findings") > 1).alias("conflict"))


def decision_points(states: DataFrame, session: str, order: str, cooldown: int = 5, most: int = 3, least_rounds: int = 12, least_read: int = 3) -> DataFrame:
    """(session, order, scenario): where a session's states call for a question.

    Of several reasons the first of saturation, contradictions, a large search space and missing relations counts. After
    a question, ``cooldown`` rounds pass without one, and a session asks ``most`` times. A session is a bounded log.
    """
    i, read = F.col("iteration"), F.col("docs_read")
    ready = (i >= least_rounds) & (read >= least_read)
    why = (
        F.when(~ready, None)
        .when(F.col("saturated") & (i >= 10), "info_saturated")
        .when(F.col("contradictions") >= 2, "contradiction")
        .when((F.col("docs_with_results") > 15) & (read <= 5) & (i >= 15), "search_space_large")
        .when((F.col("entities") >= 5) & (F.col("relations") == 0) & (read >= 3) & (i >= 12), "missing_dimension")
    )
    d = states.select(F.col(session), F.col(order), why.alias("why"), F.row_number().over(Window.partitionBy(session).orderBy(order)).alias("n"))
    log = d.where("why IS NOT NULL").groupBy(session).agg(F.sort_array(F.collect_list(F.struct("n", F.col(order).alias("at"), "why"))).alias("log"))
    start = F.struct(F.lit(-(1 << 30)).alias("last"), F.array().cast("array<int>").alias("asked"))

    def step(s, x):
        ask = (x["n"] > s["last"] + cooldown) & (F.size(s["asked"]) < most)
        return F.when(ask, F.struct(x["n"].alias("last"), F.array_append(s["asked"], x["n"]).alias("asked"))).otherwise(s)

    asked = log.select(session, "log", F.aggregate("log", start, step)["asked"].alias("asked"))
    out = asked.select(session, F.explode(F.filter("log", lambda x: F.array_contains(F.col("asked"), x["n"]))).alias("x"))
    return out.select(session, F.col("x.at").alias(order), F.col("x.why").alias("scenario"))


def document_list(documents: DataFrame, chunks: DataFrame, summaries: DataFrame, entities: DataFrame) -> DataFrame:
    """(kb_id, doc_id, lines, kilobytes, n_chunks, has_l0, has_l1, has_l2, compile_status) of every document.

    ``documents`` (kb_id, doc_id, text, compile_status), ``chunks`` and ``summaries`` (doc_id), ``entities`` (kb_id): what has
    been made. A pending document that has summaries counts as completed; a missing state is unknown.
    """
    l2 = chunks.groupBy(F.col("doc_id").alias("_c")).agg(F.count("*").alias("n"))
    l1 = summaries.select(F.col("doc_id").alias("_s")).distinct()
    l0 = entities.select(F.col("kb_id").alias("_e")).distinct()
    d = documents.join(l2, F.col("doc_id") == F.col("_c"), "left").join(l1, F.col("doc_id") == F.col("_s"), "left").join(l0, F.col("kb_id") == F.col("_e"), "left")
    has_l1 = F.col("_s").isNotNull()
    status = F.when((F.col("compile_status") == "pending") & has_l1, "completed").otherwise(F.coalesce("compile_status", F.lit("unknown")))
    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n")))
    return d.select("kb_id", "doc_id", lines.alias("lines"), F.round(F.octet_length(F.coalesce("text", F.lit(""))) / 1024, 1).alias("kilobytes"), F.coalesce("n", F.lit(0).cast("long")).alias("n_chunks"), F.col("_e").isNotNull().alias("has_l0"), has_l1.alias("has_l1"), F.col("_c").isNotNull().alias("has_l2"), status.alias("compile_status"))


def document_totals(listed: DataFrame) -> DataFrame:
    """(kb_id, total, compiled, uncompiled) of a document list."""
    done = F.col("compile_status") == "completed"
    return listed.groupBy("kb_id").agg(F.count("*").alias("total"), F.count_if(done).alias("compiled"), F.count_if(~done).alias("uncompiled"))


def document_details(documents: DataFrame, summaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, batches, chunks_covered, n_chunks): how much of each document has been summarised.

    ``summaries`` (doc_id, chunk_ids) are batches; chunks that several of them cover count each time.
    """
    l1 = summaries.groupBy(F.col("doc_id").alias("_s")).agg(F.count("*").alias("batches"), F.sum(F.size(F.coalesce("chunk_ids", F.array().cast("array<string>")))).alias("covered"))
    l2 = chunks.groupBy(F.col("doc_id").alias("_c")).agg(F.count("*").alias("n"))
    d = documents.select("doc_id").join(l1, F.col("doc_id") == F.col("_s"), "left").join(l2, F.col("doc_id") == F.col("_c"), "left")
    zero = F.lit(0).cast("long")
    return d.select("doc_id", F.coalesce("batches", zero).alias("batches"), F.coalesce("covered", zero).alias("chunks_covered"), F.coalesce("n", zero).alias("n_chunks"))


def kb_states(documents: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """(kb_id, documents, n_<layer>, has_<layer> ...): the rows that each knowledge base has in each layer (tables of kb_id)."""
    d = documents.groupBy("kb_id").agg(F.count("*").alias("documents"))
    for name, rows in layers.items():
        n = rows.groupBy(F.col("kb_id").alias("_k")).agg(F.count("*").alias(f"n_{name}"))
        d = d.join(n, F.col("kb_id").eqNullSafe(F.col("_k")), "left").drop("_k")
        d = d.withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long"))).withColumn(f"has_{name}", F.col(f"n_{name}") > 0)
    return d


def interaction_state(relevance: Column, hits: Column) -> Column:
    """no_results, low_relevance or clear."""
    return F.when(hits == 0, "no_results").when(relevance < 0.3, "low_relevance").otherwise("clear")


def rerank_scores(answer: Column) -> Column:
    """Scores in a model's JSON list of numbers or of objects with ``score``, fenced or not; null if there are none."""
    body = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    numbers = F.from_json(body, "array<double>")
    objects = F.transform(F.from_json(body, "array<struct<score:double>>"), lambda x: F.coalesce(x["score"], F.lit(5.0)))
    good = F.when(body.rlike(r"^\[\s*\{"), objects).otherwise(F.filter(numbers, lambda x: x.isNotNull()))
    return F.when(F.size(good) > 0, good)


def without_toc(chunks: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, text) from the first chapter heading on, a table of contents before it left out.

    Neighbouring heading lines are a block. The first block of three or more is a table of contents: the text begins
    where its first heading comes again in it, else at the next block, else at its last line. Without one the text begins at its first
    heading; without a heading it stays as it is. Lines of one chunk, a bounded text, are numbered in an array.
    """
    lines = F.split(text, "\n")
    d = chunks.select(F.col(key), F.col(text).alias("_text"), lines.alias("_lines"))
    n = F.size("_lines")
    heads = F.transform(F.col("_lines"), lambda x: F.trim(x).rlike(pattern))
    d = d.withColumn("_heads", heads)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("_heads", i) & ~F.coalesce(F.get("_heads", i - 1), F.lit(False)))
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("_heads", i) & ~F.coalesce(F.get("_heads", i + 1), F.lit(False)))
    d = d.withColumn("_blocks", F.arrays_zip(starts.alias("s"), ends.alias("e")))
    toc = F.filter(F.sequence(F.lit(0), F.size("_blocks") - 1), lambda i: F.get("_blocks", i)["e"] - F.get("_blocks", i)["s"] >= 2)
    d = d.withColumn("_toc", F.when(F.size("_blocks") > 0, F.get(toc, F.lit(0))))
    own = F.get("_blocks", F.col("_toc"))
    again = F.filter(F.sequence(own["s"] + 1, own["e"]), lambda i: F.trim(F.get("_lines", i)) == F.trim(F.get("_lines", own["s"])))
    begin = F.when(F.col("_toc").isNotNull(), F.coalesce(F.get(again, F.lit(0)), F.get("_blocks", F.col("_toc") + 1)["s"], own["e"])).otherwise(F.get("_blocks", F.lit(0))["s"])
    d = d.withColumn("_begin", begin)
    rest = F.trim(F.array_join(F.slice("_lines", F.col("_begin") + 1, F.greatest(n, F.lit(1))), "\n"))
    return d.select(key, F.when(F.col("_begin").isNull(), F.col("_text")).otherwise(F.regexp_replace(rest, r"^\s+|\s+$", "")).alias("text"))


def cached_documents(documents: DataFrame, digest: str, cache: DataFrame) -> DataFrame:
    """Documents with ``reused``, the compiled document of equal content, null where there is none; least id first."""
    known = cache.groupBy(F.col("file_hash").alias("_h")).agg(F.min("compiled_id").alias("reused"))
    return documents.join(known, F.col(digest) == F.col("_h"), "left").drop("_h")


def cascaded(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the rows of ``gone`` and all that hangs on them, at any depth.

    ``references`` are (child, column, parent, column): a child's row goes if its column holds a value that the parent's
    column has in a row that goes. ``gone`` maps tables to (column of the same name as in the table) keys to start from.
    A null refers to nothing; a table may have several parents; repeated rows go or stay together; tables that nothing
    leads to come back as they are. References that form a cycle, a table that refers to itself among them, and tables
    that are not there raise ValueError. Parents come before their children; only the keys of rows that go move on, in
    distinct form.
    """
    parents: dict[str, set[str]] = {t: set() for t in tables}
    for child, _, parent, _ in references:
        if child not in tables or parent not in tables:
            raise ValueError(f"no table {child if child not in tables else parent}")
        parents[child].add(parent)
    if any(t not in tables for t in gone):
        raise ValueError("gone must name tables")
    try:
        order = list(TopologicalSorter(parents).static_order())
    except CycleError as e:
        raise ValueError(f"references form a cycle: {' -> '.join(e.args[1])}") from e
    left, dead = dict(tables), {}  # dead: values of (table, column) in rows that go
    for name in order:
        t = tables[name]
        causes = [(c, gone[name].select(F.col(c).alias("_gone")).distinct()) for c in gone[name].columns] if name in gone else []
        causes += [(column, dead[parent, key]) for child, column, parent, key in references if child == name and (parent, key) in dead]
        if not causes:
            continue
        causes = [(c, small_or_shuffled(checkpointed(values.where("_gone IS NOT NULL")))) for c, values in causes]
        for column, values in causes:
            left[name] = left[name].join(values, left[name][column] == values["_gone"], "left_anti")
        for key in sorted({key for _, _, parent, key in references if parent == name}):
            lost = [t.join(values, t[column] == values["_gone"], "left_semi").select(F.col(key).alias("_gone")) for column, values in causes]
            dead[name, key] = reduce(DataFrame.union, lost).distinct()
    return left


def without_kb(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the knowledge bases in ``gone`` (kb_id); tables keyed by doc_id follow ``documents``, tables keyed
    by session_id follow ``sessions``."""
    references = []
    for name, t in tables.items():
        for key, parent in (("doc_id", "documents"), ("session_id", "sessions")):
            if "kb_id" not in t.columns and key in t.columns and parent in tables and name != parent:
                references.append((name, key, parent, key))
    return cascaded(tables, references, {n: gone.select("kb_id") for n, t in tables.items() if "kb_id" in t.columns})


def banner_rows(cells: DataFrame, merges: DataFrame, first_rows: int = 5) -> DataFrame:
    """(sheet, row, text): banners among the first rows of sheets.

    ``cells`` (sheet, row, col, value), numbered from 0; ``merges`` (sheet, row, col_span). A banner's row holds a
    merged range of at least 40 % of the sheet's width and a run of three or more equal cells that are at least 40 %
    of its cells with a value; the first such run counts.
    """
    width = cells.groupBy("sheet").agg((F.max("col") + 1).alias("width"))
    top = cells.where(F.col("row") < first_rows).select("sheet", "row", "col", F.trim("value").alias("value"))
    wide = merges.join(width, "sheet").where("col_span >= 0.4 * width").select("sheet", "row").distinct()
    row = Window.partitionBy("sheet", "row").orderBy("col")
    d = top.join(wide, ["sheet", "row"], "left_semi").where("value != ''")
    d = d.withColumn("full", F.count("*").over(Window.partitionBy("sheet", "row")))
    fresh = ~((F.lag("value").over(row) == F.col("value")) & (F.lag("col").over(row) == F.col("col") - 1))
    d = d.withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(row))
    runs = d.groupBy("sheet", "row", "run").agg(F.count("*").alias("n"), F.first("value").alias("text"), F.max("full").alias("full")).where("n >= 3 AND n >= 0.4 * full")
    return runs.groupBy("sheet", "row").agg(F.min_by("text", "run").alias("text"))


def formatted_number(value: Column, pattern: Column) -> Column:
    """A cell's number as its format shows it: dates from serial numbers, percents, currency; else as it is."""
    plain = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return (
        F.when(F.coalesce(pattern, F.lit("General")) == "General", plain)
        .when(pattern.rlike("(?i)yy|m|d"), F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(value).cast("int")), "yyyy-MM-dd"))
        .when(pattern.contains("%"), F.concat(F.replace(F.format_number(value * 100, 1), F.lit(",")), F.lit("%")))  # rounds half to even
        .when(pattern.contains("¥"), F.concat(F.lit("¥"), F.format_number(value, 2)))
        .when(pattern.rlike("[$€£]"), F.concat(F.lit("$"), F.format_number(value, 2)))
        .otherwise(plain)
    )
