"""Registered queries over the layers of a knowledge base: documents, chunks, summaries, entities, pages and their graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import assess, chunking, conversation, entities, fusion, graph, linking, search, search_index, vectors, wiki
from docloom.operators.ordering import checkpoint_folder, checkpointed, removed
from docloom.plans.case_queries import NOTE, NOTES, PEOPLE, A, B, words
from docloom.plans.graph_queries import CHAIN, _chain
from docloom.sources import files
from docloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Suppliers as entities, with repeated names and aliases; orders as relations and as summaries.
NAMES = "ents AS (SELECT s_suppkey AS seq, 'entity_' || s_suppkey AS id, 'S' || s_suppkey % 40 AS name, 'alias' || s_suppkey % 60 AS alias, CASE s_suppkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'Organization' END AS type, s_acctbal / 10000 AS confidence FROM supplier)"
RELS = "rels AS (SELECT o_orderkey, 'S' || o_custkey % 50 AS subject, o_orderpriority AS predicate, 'alias' || o_orderkey % 70 AS object FROM orders)"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    named = lambda head, n: F.concat(F.lit(head), (s % n).cast("string"))
    return table(spark, sf_dir, "supplier").select(s.alias("seq"), F.concat(F.lit("entity_"), s.cast("string")).alias("id"), named("S", 40).alias("name"), F.array(named("alias", 60)).alias("aliases"), F.when(s % 3 == 0, "person").when(s % 3 == 1, "Organization").alias("type"), (F.col("s_acctbal") / 10000).alias("confidence"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")).alias("subject"), F.col("o_orderpriority").alias("predicate"), F.concat(F.lit("alias"), (F.col("o_orderkey") % 70).cast("string")).alias("object"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as summaries of documents: their lines are chunks, their note the summary."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("string"))).alias("chunk_ids"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"), F.expr(NOTE).alias("summary"), F.array(F.expr(A), F.expr(B)).alias("names"))
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_orderkey", "doc_id", "summary", "names", "chunk_ids")


# ---- entities


@register(f"WITH {NAMES}, {RELS}, n AS (SELECT seq, id, name AS n FROM ents UNION SELECT seq, id, alias FROM ents), i AS (SELECT n, arg_max(id, seq) AS id FROM n GROUP BY n) SELECT o_orderkey, subject, object, a.id AS subject_id, b.id AS object_id FROM rels LEFT JOIN i a ON a.n = subject LEFT JOIN i b ON b.n = object")
def endpoint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir).withColumnRenamed("id", "entity_id")
    return entities.endpoint_ids(_relations(spark, sf_dir), e).select("o_orderkey", "subject", "object", "subject_id", "object_id")


@register(f"WITH {NAMES} SELECT id FROM ents WHERE lower(type) = 'organization'")
def entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.by_type(_entities(spark, sf_dir), "ORGANIZATION").select("id")


@register(f"WITH {NOTES} SELECT name, o_custkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS chunk_id, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_custkey, note, unnest([{A}, {B}]) AS name FROM notes) JOIN lineitem ON l_orderkey = o_orderkey WHERE name IN ('张伟', '李娜') GROUP BY ALL")
def entity_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame([("张伟",), ("李娜",)], "name string")
    d = entities.expanded(e, _summaries(spark, sf_dir))
    return d.groupBy("name", "doc_id", "chunk_id").agg(F.count("*").alias("n"))


@register(f"SELECT DISTINCT name FROM (SELECT unnest([{A}, {B}]) AS name FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) WHERE name <> '张伟'")
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(n,) for n in PEOPLE if n != "张伟"], "name string")
    first = table(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0]
    return entities.of_document(_summaries(spark, sf_dir), known, first)


@register(f"WITH {NOTES}, e AS (SELECT DISTINCT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, note AS title, unnest([{A}, {B}]) AS name FROM notes) SELECT name, date, title FROM e WHERE name IN ('王芳', '周杰')")
def entity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.expr(NOTE).alias("title"), F.array(F.expr(A), F.expr(B)).alias("participants"))
    return entities.events_of(spark.createDataFrame([("王芳",), ("周杰",)], "name string"), e)


@register(f"WITH {NAMES}, {RELS} SELECT name, 'isolated' AS gap, count(*) AS n FROM ents WHERE name NOT IN (SELECT subject FROM rels WHERE o_orderkey % 40 = 0) GROUP BY name UNION ALL SELECT name, 'low_confidence', count(*) FROM ents WHERE confidence < 0.4 GROUP BY name")
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.gaps(_entities(spark, sf_dir), _relations(spark, sf_dir).where("o_orderkey % 40 = 0")).groupBy("name", "gap").agg(F.count("*").alias("n"))


@register(f"WITH {RELS}, q AS (SELECT * FROM rels WHERE lower(subject) = 's1' OR lower(object) = 's1') SELECT o_orderkey, 'exact' AS asked FROM q UNION ALL SELECT o_orderkey, 'part' FROM rels WHERE contains(lower(subject), 'as1') OR contains(lower(object), 'as1')")
def relations_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _relations(spark, sf_dir)
    return entities.relations_named(r, "s1").select("o_orderkey", F.lit("exact").alias("asked")).unionByName(entities.relations_named(r, "AS1").select("o_orderkey", F.lit("part").alias("asked")))


@register("""WITH e AS (SELECT 'k' || n_regionkey AS kb_id, n_nationkey AS seq, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'location' ELSE 'unknown' END AS type FROM nation),
i AS (SELECT *, printf('entity_%s_%03d', kb_id, row_number() OVER (PARTITION BY kb_id ORDER BY seq)) AS id FROM e),
t AS (SELECT 'k' || n_regionkey AS kb_id, strftime(o_orderdate, '%Y-%m') AS time, o_orderpriority AS description, min(o_orderkey) AS seq FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
p AS (SELECT t.*, n_name FROM t JOIN orders ON o_orderkey = t.seq JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT kb_id, id, name AS label, type AS detail FROM i UNION ALL
SELECT p.kb_id, printf('event_%s_%03d', p.kb_id, row_number() OVER (PARTITION BY p.kb_id ORDER BY p.seq)), p.time || ' ' || description, i.id FROM p JOIN i ON i.kb_id = p.kb_id AND i.name = n_name""")
def layer_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = F.concat(F.lit("k"), F.col("n_regionkey").cast("string")).alias("kb_id")
    n = table(spark, sf_dir, "nation")
    e = n.select(kb, F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "location").alias("type"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    events = o.select(kb, F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM").alias("time"), F.col("o_orderpriority").alias("description"), F.array("n_name", F.lit("nobody")).alias("participants"))
    found, happened = entities.normalised_layer(e, events)
    happened = happened.select("kb_id", "id", F.concat_ws(" ", "time", "description").alias("label"), F.array_join("participants", ",").alias("detail"))
    return found.select("kb_id", "id", F.col("name").alias("label"), F.col("type").alias("detail")).unionByName(happened)


@register(f"""WITH {NAMES}, k AS (SELECT * FROM ents WHERE confidence >= 0.3), i AS (SELECT lower(name) AS low, arg_max(id, seq) AS id FROM k GROUP BY 1),
q AS (SELECT DISTINCT unnest(['S' || o_custkey % 50, 'the S' || o_orderkey % 45]) AS q FROM orders),
f AS (SELECT q, arg_min(low, (p, seq)) AS low FROM (SELECT q, lower(k.name) AS low, k.seq, CASE WHEN lower(q) = lower(k.name) THEN 0 ELSE 1 END AS p FROM q JOIN k ON contains(lower(q), lower(k.name)) OR contains(lower(k.name), lower(q))) GROUP BY q),
r AS (SELECT a.id AS source_id, b.id AS target_id, o_orderpriority AS relation_type FROM orders JOIN f x ON x.q = 'S' || o_custkey % 50 JOIN i a ON a.low = x.low JOIN f y ON y.q = 'the S' || o_orderkey % 45 JOIN i b ON b.low = y.low)
SELECT entity_id, relation_type, count(*) AS n FROM (SELECT source_id AS entity_id, relation_type FROM r UNION ALL SELECT target_id, relation_type FROM r WHERE target_id <> source_id) GROUP BY ALL""")
def report_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    r = o.select(F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")).alias("source"), F.concat(F.lit("the S"), (F.col("o_orderkey") % 45).cast("string")).alias("target"), F.col("o_orderpriority").alias("relation_type"), F.lit(None).cast("double").alias("confidence"))
    return entities.reported(_entities(spark, sf_dir), r)[1].groupBy("entity_id", "relation_type").agg(F.count("*").alias("n"))


# ---- graph


@register(f"WITH {CHAIN} SELECT src, dst, 'follows' AS label FROM chain UNION ALL SELECT dst, src, 'follows(反向)' FROM chain")
def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.event_graph(_chain(spark, sf_dir).withColumn("label", F.lit("follows")))


@register(f"WITH {CHAIN} SELECT src, dst FROM both_ways WHERE src IN (5, 6, 77)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.induced(graph.both_ways(_chain(spark, sf_dir)), spark.createDataFrame([(5,), (6,), (77,), (5,)], "node long"))


@register("""WITH e AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b FROM nation) SELECT 0 AS hop, 'N0' AS src, 'R' || n_regionkey AS dst, 'in' AS label FROM nation WHERE n_nationkey = 0
UNION ALL SELECT 1, 'R' || n_regionkey, 'N' || (SELECT max(n_nationkey) FROM nation m WHERE m.n_regionkey = nation.n_regionkey), 'in(反向)' FROM nation WHERE n_nationkey = 0""")
def path_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("in").alias("label"))
    last = n.join(n.where("n_nationkey = 0").select("n_regionkey"), "n_regionkey").agg(F.max("n_nationkey")).first()[0]
    return graph.path_edges(graph.shortest_path(r, "N0", f"N{last}"), r)


@register("""WITH c AS (SELECT * FROM (VALUES ('person', '#6366f1'), ('organization', '#f59e0b'), ('location', '#10b981'), ('event', '#ef4444'), ('unknown', '#8b5cf6'), ('gadget', '#8b5cf6')) AS t(type, color)),
n AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS label, CASE s_suppkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'location' WHEN 2 THEN 'gadget' ELSE 'unknown' END AS type FROM supplier
UNION ALL SELECT 'e' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority, 'event' FROM orders) SELECT 'node' AS part, id AS a, label AS b, type || color AS c FROM n JOIN c USING (type)
UNION ALL SELECT 'edge', CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR), 'near' FROM supplier UNION ALL SELECT 'edge', 'e' || o_orderkey, CAST(o_custkey AS VARCHAR), 'participant' FROM orders""")
def graph_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    kind = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'location' WHEN 2 THEN 'gadget' END")
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("description"), F.array("o_custkey").alias("participants"))
    nodes, edges = graph.payload(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), kind.alias("type")), o, s.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"), F.lit("near").alias("label")))
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("label").alias("b"), F.concat("type", "color").alias("c")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("label").alias("c")))


@register("SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS subject, '共现' AS predicate, greatest(a.l_suppkey, b.l_suppkey) AS object FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey UNION ALL SELECT n_nationkey, 'in', n_regionkey FROM nation")
def guarded_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs where there are no relations, and the relations alone where there are."""
    li, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "nation")
    r = n.select(F.col("n_nationkey").cast("long").alias("subject"), F.lit("in").alias("predicate"), F.col("n_regionkey").cast("long").alias("object"))
    return graph.guarded_relations(r.limit(0), li, "l_orderkey", "l_suppkey").unionByName(graph.guarded_relations(r, li, "l_orderkey", "l_suppkey"))


@register("SELECT p_partkey, 'pattern' AS how FROM part WHERE regexp_matches(p_name, '(?i)^[a-m].*e$') UNION ALL SELECT p_partkey, 'literal' FROM part WHERE contains(lower(p_brand || '('), '1(')")
def recalled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = graph.matching_nodes(p, "^[A-M].*E$", "p_name").select("p_partkey", F.lit("pattern").alias("how"))
    return a.unionByName(graph.matching_nodes(p.withColumn("t", F.concat("p_brand", F.lit("("))), "1(", "t").select("p_partkey", F.lit("literal").alias("how")))


# ---- documents and layers


@register("""WITH c AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 3 > 0), s AS (SELECT DISTINCT doc_id FROM labels)
SELECT source AS kb_id, d.doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS INT) AS lines, CAST(round(octet_length(encode(coalesce(text, ''))) / 1024, 1) AS DOUBLE) AS kilobytes, CAST(coalesce(c.n, 0) AS BIGINT) AS n_chunks, source < 'src5' AS has_l0, s.doc_id IS NOT NULL AS has_l1, c.n IS NOT NULL AS has_l2,
       CASE WHEN d.doc_id % 4 = 0 THEN 'unknown' WHEN s.doc_id IS NOT NULL THEN 'completed' ELSE 'pending' END AS compile_status FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id"), "doc_id", "text", F.when(F.col("doc_id") % 4 > 0, "pending").alias("compile_status"))
    chunks = d.where("doc_id % 3 > 0").select("doc_id", F.explode(F.split("text", "\n")))
    return assess.document_list(d, chunks, table(spark, sf_dir, "labels"), d.where("kb_id < 'src5'"))


@register("WITH s AS (SELECT DISTINCT doc_id FROM labels), x AS (SELECT source, doc_id % 4 > 0 AND s.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN s USING (doc_id)) SELECT source AS kb_id, count(*) AS total, count(*) FILTER (done) AS compiled, count(*) FILTER (NOT done) AS uncompiled FROM x GROUP BY 1".replace("doc_id % 4", "d.doc_id % 4"))
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.document_totals(document_list(spark, sf_dir))


@register("WITH b AS (SELECT o_custkey AS d, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT o_custkey AS d, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey AS doc_id, coalesce(b.n, 0) AS batches, coalesce(l.n, 0) AS chunks_covered, coalesce(l.n, 0) AS n_chunks FROM customer LEFT JOIN b ON b.d = c_custkey LEFT JOIN l ON l.d = c_custkey")
def document_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ids = li.groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("chunk_ids"))
    s = o.join(ids, o["o_orderkey"] == ids["l_orderkey"], "left").select(F.col("o_custkey").alias("doc_id"), "chunk_ids")
    chunks = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("doc_id"))
    return assess.document_details(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), s, chunks)


@register("SELECT p_partkey, 'c' || p_partkey || ' ' || p_name AS body, '# c' || p_partkey || chr(10) || '**Doc:** ' || p_brand || chr(10) || '**Token Count:** ' || p_size || chr(10) || '---' || chr(10) || 'c' || p_partkey || ' ' || p_name AS stored FROM part")
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("c"), F.col("p_partkey").cast("string"))
    stored = chunking.with_header(key, F.col("p_brand"), F.col("p_size"), F.concat_ws(" ", key, "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", stored.alias("stored")).select("p_partkey", chunking.strip_header(F.col("stored")).alias("body"), "stored")


@register("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS fields, 'body of ' || p_partkey AS body FROM part")
def front_matter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("body of "), F.col("p_partkey").cast("string"))
    text = F.when(F.col("p_partkey") % 5 == 0, body).otherwise(F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\nkind: "), "p_brand", F.lit(": x\n---\n"), body))
    return wiki.pages_of(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "p_partkey", "t").select("p_partkey", "title", F.size("meta").alias("fields"), "body")


EXTENSIONS = ["a.PDF", "b.docx", "c.doc", "d.xlsx", "e.xls", "f.csv", "g.jpeg", "h.webp", "i.txt", "j.md", "k.exe", "noextension"]
FAMILIES = ["pdf", "docx", "doc", "sheet", "sheet", "sheet", "image", "image", "text", "text", "", ""]


@register(f"SELECT {words('p_partkey', FAMILIES)} AS family, {words('p_partkey', ['vision', 'layout', 'text'])} AS route, count(*) AS n FROM part GROUP BY ALL")
def file_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.expr("CASE p_partkey % 3 WHEN 0 THEN 99 WHEN 1 THEN 100 ELSE 2000 END")
    return table(spark, sf_dir, "part").groupBy(F.coalesce(files.family(F.expr(words("p_partkey", EXTENSIONS))), F.lit("")).alias("family"), files.pdf_route(chars).alias("route")).agg(F.count("*").alias("n"))


@register("SELECT CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS part, count(*) AS n, round(CAST(max(CASE WHEN vec_id % 5 = 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE), 4) AS longest FROM embeddings WHERE vec_id % 7 > 0 GROUP BY 1")
def vector_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector is appended again, those of every seventh document deleted."""
    v = table(spark, sf_dir, "embeddings")
    index = vectors.append_vectors(v.where("vec_id % 5 > 0 OR vec_id % 2 = 0"), v.where("vec_id % 5 = 0"), "vec_id")
    index = vectors.without_documents(index, v.where("vec_id % 7 = 0"), "vec_id")
    fresh = F.col("vec_id") % 5 == 0
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return index.groupBy(F.when(fresh, "new").otherwise("old").alias("part")).agg(F.count("*").alias("n"), F.round(F.max(F.when(fresh, length).otherwise(0.0)), 4).alias("longest"))


@register("WITH l AS (SELECT length(text) AS n, doc_id FROM documents), o AS (SELECT doc_id, n FROM l WHERE n > 2000) SELECT count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS ids FROM o")
def progressive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level is empty, the second not relevant enough."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    levels = [("L0", d.where("n < 0").withColumn("relevance", F.lit(1.0))), ("L1", d.where("n < 100").withColumn("relevance", F.lit(0.3))), ("L2", d.where("n > 2000").withColumn("relevance", F.lit(0.1)))]
    return fusion.progressive(levels).agg(F.count("*").alias("n_rows"), F.sum("doc_id").alias("ids"))


@register("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'L0' WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' WHEN 3 THEN 'L2' ELSE 'unknown' END AS layer, CASE WHEN p_size / 50.0 > 0.7 THEN 'EXTRACTED' WHEN p_size / 50.0 > 0.3 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM part")
def enriched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.expr(words("p_partkey", ["l0_x", "l1_x", "l2_x", "d1_chunk_1", "plain"]))
    return table(spark, sf_dir, "part").select("p_partkey", fusion.source_layer(chunk).alias("layer"), fusion.score_confidence(F.col("p_size") / 50.0).alias("confidence"))


SCORE = " + ".join(f"CASE WHEN contains(lower({c}), '{w}') THEN {n} ELSE 0 END" for w in ("small", "ring") for c, n in (("p_name", 3), ("p_brand", 1), ("p_type", 2)))


@register(f"SELECT p_partkey, CAST({SCORE} + CASE WHEN contains(lower(p_name), 'small ring') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'small ring') THEN 2 ELSE 0 END AS INT) AS score FROM part")
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", search.entity_score(F.col("p_name"), F.col("p_type"), F.col("p_brand"), "small RING").alias("score"))


@register("SELECT n_nationkey AS node, 'C' || c_custkey AS entity FROM nation JOIN customer ON n_name = CASE WHEN c_custkey % 2 = 0 THEN (SELECT n_name FROM nation m WHERE m.n_nationkey = c_custkey % 25) ELSE 'none' END OR n_name = (SELECT n_name FROM nation m WHERE m.n_nationkey = c_nationkey)")
def catalog_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    own = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("first"))
    e = c.join(own, F.col("c_custkey") % 25 == F.col("a")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    e = e.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("first")).otherwise("none").alias("name"), F.array("n_name").alias("aliases"))
    return wiki.catalog_entities(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")), e)


@register("""WITH r AS (SELECT n_name, '- has [[' || s_name || ']]' AS line, row_number() OVER (PARTITION BY n_name ORDER BY '- has [[' || s_name || ']]') AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT DISTINCT n_name, '- ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderstatus AS line FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), ek AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY line) AS k FROM e)
SELECT n_name AS name, '# ' || n_name || chr(10) || '**Type:** nation' || chr(10) || '## Relations' || chr(10) || coalesce((SELECT string_agg(line, chr(10) ORDER BY line) FROM r WHERE r.n_name = nation.n_name AND k <= 20), '-') || chr(10) || '## Timeline' || chr(10) || coalesce((SELECT string_agg(line, chr(10) ORDER BY line) FROM ek WHERE ek.n_name = nation.n_name AND k <= 15), '-') AS content FROM nation""")
def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("subject"), F.lit("has").alias("predicate"), F.col("s_name").alias("object"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    e = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("n_name").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("title"))
    return wiki.entity_pages(n.select(F.col("n_name").alias("name"), F.lit("nation").alias("type")), s, e)


@register("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '[[x|' || p_brand || ']] then [[t/' || p_brand || '|' || p_brand || ']], and ' || p_brand WHEN p_partkey % 3 = 1 THEN 'my [[t/' || p_brand || '|' || p_brand || ']]; ' || p_brand || 'x' ELSE 'nothing here' END AS text FROM part")
def inserted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("p_brand")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("[[x|"), b, F.lit("]] then "), b, F.lit(", and "), b)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("my "), b, F.lit("; "), b, F.lit("x"))).otherwise("nothing here")
    p = table(spark, sf_dir, "part").select("p_partkey", b, text.alias("text"))
    return linking.link_first(p, "p_partkey", "text", p.select("p_partkey", b.alias("term"), F.concat(F.lit("t/"), b).alias("target")))


# ---- sessions


@register("""WITH n AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'finding' WHEN 1 THEN 'action' WHEN 2 THEN 'decision' WHEN 3 THEN 'pending' WHEN 4 THEN 'other' ELSE 'finding' END AS type, CASE WHEN role = 'user' THEN 'critical' ELSE 'high' END AS importance, role, turn AS t FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN type = 'finding' THEN 0 WHEN type = 'action' THEN 1 WHEN type = 'decision' THEN 2 WHEN type = 'pending' THEN 3 WHEN importance = 'critical' THEN 0 ELSE 1 END AS s,
      '- ' || CASE WHEN importance = 'critical' THEN '[关键]' ELSE '[重要]' END || ' ' || role || ': turn ' || turn || CASE WHEN turn % 2 = 0 THEN ' (相关: ' || role || ', two)' ELSE '' END AS line FROM n),
p AS (SELECT conv_id, s, '## ' || ['关键信息', '已完成工作', '决策与结论', '待办事项'][s + 1] || chr(10) || string_agg(line, chr(10) ORDER BY turn, line) AS text FROM l GROUP BY conv_id, s)
SELECT conv_id, '<!-- SESSION_MEMORY_START -->' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY s) || chr(10) || '<!-- SESSION_MEMORY_END -->' AS text FROM p GROUP BY conv_id""")
def session_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("topic"), F.concat(F.lit("turn "), t.cast("string")).alias("summary"), F.when(t % 2 == 0, F.array("role", F.lit("two"))).alias("entities"), F.when(F.col("role") == "user", "critical").otherwise("high").alias("importance"), F.expr("CASE turn % 6 WHEN 0 THEN 'finding' WHEN 1 THEN 'action' WHEN 2 THEN 'decision' WHEN 3 THEN 'pending' WHEN 4 THEN 'other' END").alias("type"))
    return conversation.session_notes(c, "conv_id", "turn")


@register("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS s, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS u FROM conversations)
SELECT DISTINCT conv_id, turn, role FROM r WHERE k <= 2 OR turn = s OR turn = u""")
def emergency_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.emergency_compacted(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 2).select("conv_id", "turn", "role").distinct()


@register("""WITH m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM m)
SELECT conv_id, turn, role FROM r WHERE conv_id % 2 = 1 OR k <= 3 OR (f = 1 AND role = 'system') UNION ALL SELECT DISTINCT conv_id, NULL, 'system' FROM m WHERE conv_id % 2 = 0""")
def notes_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").distinct()
    n = m.where("conv_id % 2 = 0").select("conv_id", F.lit("what was found").alias("text")).distinct()
    return conversation.notes_compacted(m, "conv_id", "turn", "role", "text", n, 3).select("conv_id", "turn", "role")


@register("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, CASE WHEN role = 'assistant' AND k > 1 AND length(text) > 40 THEN text[:40] || chr(10) || '[cache_edit截断]' ELSE text END AS text FROM r")
def cut_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.cut_results(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "assistant", 1, 40).select("conv_id", "turn", "text")


@register("""WITH e AS (SELECT user_id, event_id, CAST(floor(value / 5) AS INT) AS h FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, h ORDER BY event_id) = 1 AS first FROM e),
s AS (SELECT *, coalesce(sum(CAST(first AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM f) SELECT user_id, event_id FROM s WHERE NOT first AND seen > 3""")
def repeated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repeated_results(table(spark, sf_dir, "events").withColumn("h", F.floor(F.col("value") / 5)), "user_id", "event_id", "h")


# ---- a written index


@register("""WITH tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, coalesce(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')), 0) AS n FROM documents), st AS (SELECT count(*) AS n_all, avg(n) AS avg_n FROM dl),
df AS (SELECT term, greatest(1e-6, ln((n_all - count(*) + 0.5) / (count(*) + 0.5))) AS idf, any_value(avg_n) AS avg_n FROM tf, st WHERE term IN ('licensed', 'under') GROUP BY term, n_all),
s AS (SELECT doc_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))) AS rank, count(*) AS terms FROM tf JOIN df USING (term) JOIN dl USING (doc_id) GROUP BY doc_id)
SELECT doc_id, round(rank, 6) AS rank FROM s WHERE terms = 2 ORDER BY round(rank, 9), doc_id LIMIT 10""")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the inverted index below the checkpoint folder, as a corpus' index would be once, and asks it."""
    out = f"{checkpoint_folder(spark)}/index_{uuid.uuid4().hex}"
    try:
        search.write_index(table(spark, sf_dir, "documents"), out)
        found = search.bm25_of_index(spark, out, "Licensed under", 10)
        return checkpointed(found.select("doc_id", F.round("rank", 6).alias("rank")))
    finally:
        removed(spark, out)


@register(ORACLES["index_search"].replace("FROM documents", "FROM (SELECT * FROM documents WHERE lang IS DISTINCT FROM 'de')"))
def segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index kept up by three batches: half of the documents come with their source as text, then with their own, then
    those of one language go."""
    out = f"{checkpoint_folder(spark)}/segments_{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents")
    late = F.col("doc_id") % 2 == 1
    try:
        index = search_index.SegmentIndex(spark, out)
        index.update(0, d.select("doc_id", F.when(late, F.col("source")).otherwise(F.col("text")).alias("text")))
        index.update(1, d.where(late).select("doc_id", "text"))
        index.update(2, gone=d.where("lang = 'de'").select("doc_id"))
        return checkpointed(index.search("Licensed under", 10).select("doc_id", F.round("rank", 6).alias("rank")))
    finally:
        removed(spark, out)
