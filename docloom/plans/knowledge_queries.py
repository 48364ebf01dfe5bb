"""Registered queries that link names and texts, check a compiled knowledge base and fuse searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import assess, entities, fusion, graph, linking, search, vectors, wiki
from docloom.plans.graph_queries import CHAIN, _chain
from docloom.plans.search_queries import EMBEDDED, bm25_sql, embedded_query
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


@register(r"""WITH t AS (SELECT conv_id || ':' || turn AS id, text FROM conversations), n AS (SELECT DISTINCT regexp_extract(text, '^([^ \n]+ [^ \n]+)', 1) AS name FROM conversations)
SELECT id, name, CAST(min(strpos(text, name) - 1) AS INT) AS at FROM t JOIN n ON contains(text, name) WHERE name <> '' GROUP BY ALL""")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    names = c.select(F.regexp_extract("text", r"^([^ \n]+ [^ \n]+)", 1).alias("name"))
    return linking.named_in(c.select(F.concat("conv_id", F.lit(":"), "turn").alias("id"), "text"), "id", "text", names)


@register("""WITH e AS (SELECT p_name AS name, min(p_partkey) AS o FROM part GROUP BY 1), q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS query FROM part UNION SELECT upper(p_name) FROM part UNION SELECT p_name || ' of note' FROM part),
m AS (SELECT query, name, o, CASE WHEN lower(query) = lower(name) THEN 0 ELSE 1 END AS p FROM q JOIN e ON contains(lower(name), lower(query)) OR contains(lower(query), lower(name)))
SELECT query, name, CASE WHEN p = 0 THEN 'exact' ELSE 'partial' END AS how FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY p, o, name) = 1""")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    asked = p.select(F.explode(F.split("p_name", " ")).alias("q")).union(p.select(F.upper("p_name"))).union(p.select(F.concat("p_name", F.lit(" of note"))))
    return linking.find_names(asked, "q", p.groupBy("p_name").agg(F.min("p_partkey").alias("o")), "p_name", "o")


@register("WITH d AS (SELECT DISTINCT p_brand AS d FROM part), c AS (SELECT p_partkey, p_brand || '-' || p_name AS t FROM part) SELECT p_partkey, max_by(d, length(d)) AS doc FROM c LEFT JOIN d ON starts_with(t, d) GROUP BY p_partkey")
def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return linking.by_prefix(p.withColumn("t", F.concat("p_brand", F.lit("-"), "p_name")), "p_partkey", "t", p, "p_brand")


@register("WITH d AS (SELECT DISTINCT lower(p_brand) AS d FROM part), c AS (SELECT p_partkey, p_name || ' ' || p_brand AS reference FROM part) SELECT p_partkey, reference, EXISTS (SELECT 1 FROM d WHERE contains(lower(reference), d)) AS verified FROM c")
def verified_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return linking.verified_references(p.withColumn("t", F.concat("p_name", F.lit(" "), "p_brand")), "p_partkey", "t", p, "p_brand")


@register("""WITH r AS (SELECT o_custkey AS s, o_orderstatus AS p, l_suppkey AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey), e AS (SELECT s_suppkey AS name FROM supplier WHERE s_acctbal < 0)
SELECT name, other, predicate, direction, CASE WHEN other IN (SELECT name FROM e) THEN 'supplier' END AS other_type FROM (SELECT s AS name, o AS other, p AS predicate, 'out' AS direction FROM r UNION ALL SELECT o, s, p, 'in' FROM r) WHERE name IN (SELECT name FROM e)""")
def entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    r = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("predicate"), F.col("l_suppkey").alias("object"))
    return entities.relations_of(r, table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("name"), F.lit("supplier").alias("type")))


MENTION_DAYS = "m AS (SELECT DISTINCT user_id AS name, strftime(ts, '%Y-%m-%d') AS doc FROM events)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("doc"))


@register(f"""WITH {CHAIN}, {MENTION_DAYS}, z AS (SELECT name, count(*) AS n FROM m GROUP BY name)
SELECT src, dst, count(*) AS shared, round(count(*) / least(any_value(a.n), any_value(b.n)), 9) AS overlap FROM (SELECT DISTINCT src, dst FROM chain) JOIN m x ON x.name = src JOIN m y ON y.name = dst AND x.doc = y.doc JOIN z a ON a.name = src JOIN z b ON b.name = dst GROUP BY src, dst""")
def shared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.shared_documents(_chain(spark, sf_dir), _days(spark, sf_dir)).withColumn("overlap", F.round("overlap", 9))


@register("SELECT p_name AS name, p_size AS importance, CASE WHEN p_type = 'ECONOMY' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, p_partkey FROM part ORDER BY p_size DESC, CASE WHEN p_type = 'ECONOMY' THEN 3 ELSE 2 END DESC, p_partkey LIMIT 10")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("importance"), F.when(F.col("p_type") == "ECONOMY", "EXTRACTED").otherwise("INFERRED").alias("confidence"), "p_name")
    return entities.top_entities(p).select(F.col("p_name").alias("name"), "importance", "confidence", F.col("name").alias("p_partkey"))


ISSUES = "CASE WHEN e = 0 THEN 'no_entities' END, CASE WHEN e > 0 AND e < 2 AND b > 5 THEN 'too_few_entities' END, CASE WHEN e > b * 50 THEN 'too_many_entities' END, CASE WHEN t = 0 AND b > 3 THEN 'empty_timeline' END, CASE WHEN r = 0 AND e > 1 THEN 'no_relations' END, CASE WHEN g = 0 AND b > 3 THEN 'empty_event_graph' END"


@register(f"""WITH c AS (SELECT c_nationkey AS kb_id, count(*) FILTER (c_mktsegment = 'BUILDING') AS e, count(*) FILTER (c_acctbal < -900) AS r, count(*) FILTER (c_acctbal > 9900) AS t, count(*) FILTER (c_acctbal > 9800) AS g, count(*) // 8 AS b FROM customer GROUP BY 1),
i AS (SELECT kb_id, array_to_string(list_filter([{ISSUES}], lambda x: x IS NOT NULL), ',') AS issues FROM c) SELECT kb_id, issues, CASE WHEN issues = '' THEN 'pass' ELSE 'needs_review' END AS status FROM i""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("kb_id")).agg(
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("entities"), F.count_if(b < -900).alias("relations"), F.count_if(b > 9900).alias("events"), F.count_if(b > 9800).alias("graph_nodes"), F.floor(F.count("*") / 8).alias("batches")
    )
    return assess.quality_issues(c).select("kb_id", F.array_join("issues", ",").alias("issues"), "status")


KINDS = "CASE WHEN quality = 1 AND toxic = 1 THEN 'evidence' WHEN doc_id % 2 = 0 THEN 'person' ELSE 'concept' END"


@register(f"""WITH e AS (SELECT source AS kb_id, {KINDS} AS type FROM documents JOIN labels USING (doc_id)), n AS (SELECT kb_id, type, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT kb_id, coalesce(sum(n) FILTER (type = 'evidence'), 0) AS v, coalesce(sum(n) FILTER (type = 'person'), 0) AS o, coalesce(sum(n) FILTER (type = 'concept'), 0) AS c FROM n GROUP BY kb_id)
SELECT kb_id, CASE WHEN v > 0 OR (o > 0 AND o >= c) THEN 'legal' ELSE 'general' END AS domain FROM p""")
def kb_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "evidence").when(F.col("doc_id") % 2 == 0, "person").otherwise("concept")
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return assess.domains(d.select(F.col("source").alias("kb_id"), kind.alias("type")))


@register("""WITH m AS (SELECT DISTINCT p_brand || p_size AS name, p_type AS doc FROM part), d AS (SELECT name, count(*) AS n FROM m GROUP BY name),
k AS (SELECT CASE WHEN p_size <= 45 THEN 'item' ELSE 'size' || p_size END AS type, count(*) AS n FROM part GROUP BY 1), z AS (SELECT sum(n) AS total, count(*) AS kinds FROM k),
t AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS s, o_orderpriority AS subject FROM orders), w AS (SELECT *, lag(date) OVER (ORDER BY s) AS p FROM t)
SELECT 'isolated_entity' AS kind, CAST(0.7 AS DOUBLE) AS score, name AS subject FROM d WHERE n <= 1 AND (SELECT avg(n) FROM d) > 2
UNION ALL SELECT 'cross_doc_contradiction', 0.75, name FROM d WHERE n >= 2 AND name IN (SELECT p_brand || p_size FROM part WHERE p_retailprice > 1000)
UNION ALL SELECT 'temporal_anomaly', 0.85, subject FROM w WHERE date < p
UNION ALL SELECT 'skewed_distribution', 0.5, type FROM k, z WHERE total > 10 AND kinds > 2 AND n > 0.8 * total""")
def surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    name = F.concat("p_brand", "p_size").alias("name")
    attributes = F.when(F.col("p_retailprice") > 1000, F.create_map(F.lit("price"), F.col("p_retailprice").cast("string")))
    e = p.select(name, F.when(F.col("p_size") <= 45, "item").otherwise(F.concat(F.lit("size"), "p_size")).alias("type"), attributes.alias("attributes"))
    events = o.select(F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("title"))
    return assess.surprises(p.select(name, F.col("p_type").alias("doc")), e, events)


@register(r"""WITH f AS (SELECT conv_id AS session, role AS task, turn AS seq, regexp_extract(text, '^([^ \n]+)', 1) AS entity, text AS finding FROM conversations),
g AS (SELECT session, entity, count(DISTINCT task) AS sources, count(DISTINCT finding) AS findings, min(seq) AS first FROM f GROUP BY ALL),
p AS (SELECT *, max(sources) OVER (PARTITION BY session) AS best, row_number() OVER (PARTITION BY session ORDER BY first, entity) AS place FROM g)
SELECT session, entity, sources, sources > 1 OR (best <= 1 AND place <= 20) AS kept, findings > 1 AS conflict FROM p""")
def synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return assess.synthesis(c.select(F.col("conv_id").alias("session"), F.col("role").alias("task"), F.col("turn").alias("seq"), F.regexp_extract("text", r"^([^ \n]+)", 1).alias("entity"), F.col("text").alias("finding")))


@register()
def decision_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    d = e.select("user_id", "event_id", n.alias("iteration"), n.alias("docs_read"), (F.col("event_type") == "error").alias("saturated"), (F.col("value") % 4).cast("int").alias("contradictions"), F.lit(0).alias("docs_with_results"), F.lit(5).alias("entities"), (F.col("value") % 7).cast("int").alias("relations"))
    return assess.decision_points(d, "user_id", "event_id")


@register()
def toc_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.without_toc(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "^[A-E]")


@register("SELECT d.doc_id, c.reused FROM documents d LEFT JOIN (SELECT sha256(text) AS h, min(doc_id) AS reused FROM documents WHERE lang = 'en' GROUP BY 1) c ON sha256(d.text) = h")
def compile_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    cache = d.where("lang = 'en'").select(F.col("digest").alias("file_hash"), F.col("doc_id").alias("compiled_id"))
    return assess.cached_documents(d, "digest", cache).select("doc_id", "reused")


@register("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kb_id"))
    left = assess.without_kb({"documents": d, "labels": table(spark, sf_dir, "labels")}, d.where("kb_id IN ('src1', 'src2')"))
    return left["labels"].select("doc_id", "quality")


@register("""WITH n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT LIKE 'A%' AND n_nationkey <> 7),
c AS (SELECT c_custkey FROM customer JOIN n ON c_nationkey = n_nationkey), s AS (SELECT s_suppkey FROM supplier JOIN n ON s_nationkey = n_nationkey),
o AS (SELECT o_orderkey FROM orders JOIN c ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
SELECT 'region' AS "table", CAST(r_regionkey AS VARCHAR) AS key FROM region WHERE r_name NOT LIKE 'A%'
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM n UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM c UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM s
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM o UNION ALL SELECT 'lineitem', l_orderkey || ':' || l_linenumber FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN s ON l_suppkey = s_suppkey
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part""")
def cascade_delete_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "part": "p_partkey"}
    t = {n: table(spark, sf_dir, n) for n in (*keys, "lineitem")}
    references = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey")]
    references += [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
    gone = {"region": t["region"].where("r_name LIKE 'A%'").select("r_regionkey"), "nation": t["nation"].where("n_nationkey = 7").select("n_nationkey"), "orders": t["orders"].where("o_orderstatus = 'P'").select("o_orderkey")}
    left = assess.cascaded(t, references, gone)
    rows = [left[n].select(F.lit(n).alias("table"), F.col(k).cast("string").alias("key")) for n, k in keys.items()]
    rows.append(left["lineitem"].select(F.lit("lineitem").alias("table"), F.concat("l_orderkey", F.lit(":"), "l_linenumber").alias("key")))
    return reduce(DataFrame.union, rows)


@register("""SELECT p_partkey, strftime(DATE '1899-12-30' + CAST(p_partkey AS INT), '%Y-%m-%d') AS date, printf('%.1f', p_size / 64.0 * 100) || '%' AS share, '¥' || format('{:,.2f}', p_partkey * 0.25) AS price, CAST(p_size AS VARCHAR) AS plain FROM part""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = assess.formatted_number
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", f(F.col("p_partkey").cast("double"), F.lit("yyyy-mm-dd")).alias("date"), f(size / 64.0, F.lit("0.0%")).alias("share"), f(F.col("p_partkey") * 0.25, F.lit("¥#,##0.00")).alias("price"), f(size, F.lit("General")).alias("plain"))


@register("WITH RECURSIVE e AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier), r(node, distance) AS (SELECT 'R1', 0 UNION SELECT dst, distance + 1 FROM r JOIN e ON node = src WHERE distance < 2) SELECT node, distance FROM r")
def summary_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("S"), "s_suppkey").alias("dst"))
    return graph.descendants(n.unionByName(s), spark.createDataFrame([("R1",)], "node string"), 2)


@register(f"""WITH {CHAIN}, deg AS (SELECT src AS via, count(*) AS d FROM both_ways GROUP BY src HAVING count(*) > 1),
cm AS (SELECT a.dst AS src, b.dst AS dst, sum(1 / ln(d)) AS aa FROM both_ways a JOIN both_ways b ON a.src = b.src AND a.dst <> b.dst JOIN deg ON deg.via = a.src WHERE a.dst = 5 GROUP BY ALL),
dr AS (SELECT 5::BIGINT AS src, CASE WHEN src = 5 THEN dst ELSE src END AS dst, CAST(count(*) AS DOUBLE) AS w FROM chain WHERE src <> dst AND (src = 5 OR dst = 5) GROUP BY ALL),
f AS (SELECT dst, greatest(CASE WHEN w IS NULL THEN 0.0 ELSE least(0.3 + 0.1 * w, 0.8) END, least(coalesce(aa, 0) / 5, 0.6)) AS a FROM dr FULL JOIN cm USING (src, dst))
SELECT user_id, round(CAST(s * (1 + 0.3 * coalesce(a, 0)) AS DOUBLE), 6) AS boosted_score FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS s FROM events GROUP BY 1) LEFT JOIN f ON dst = user_id""")
def affinity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("s"))
    near = graph.affinity(_chain(spark, sf_dir).withColumn("weight", F.lit(1.0)))
    return graph.boosted(rows, "user_id", "s", rows.select("user_id", F.col("user_id").alias("entity")), near, [5]).select("user_id", F.round("boosted_score", 6).alias("boosted_score"))


@register("""WITH p AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey), q AS (SELECT id AS asked FROM p UNION SELECT title FROM p UNION SELECT path FROM p UNION SELECT 'nothing')
SELECT asked, p.id, CASE WHEN asked = p.id THEN 'id' WHEN asked = title THEN 'title' ELSE 'catalog_path' END AS found_by FROM q JOIN p ON asked = p.id OR asked = title OR asked = path""")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    p = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.concat("r_name", F.lit("/"), "n_name").alias("catalog_path"))  # five rows
    asked = p.select(F.col("id").alias("asked")).union(p.select("title")).union(p.select("catalog_path")).union(spark.createDataFrame([("nothing",)], "asked string"))
    return wiki.lookup(p, asked)


@register(f"""WITH {bm25_sql("benchmark", "item_id", ["in", "of", "the"])}, {EMBEDDED}, k AS (SELECT item_id AS doc_id, row_number() OVER (ORDER BY round(rank, 9), item_id) AS r FROM best),
qv(dim, w) AS (VALUES {embedded_query("The of in")}),
cs AS (SELECT doc_id, sum(CAST(value AS DOUBLE) * w) / sqrt(any_value(sq)) / (SELECT sqrt(sum(w * w)) FROM qv) AS s FROM (SELECT *, sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE)) OVER (PARTITION BY doc_id) AS sq FROM emb) JOIN qv USING (dim) GROUP BY doc_id),
v AS (SELECT doc_id, s, row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS r FROM cs QUALIFY r <= 10),
f AS (SELECT doc_id, sum(1.0 / (60 + r)) AS score FROM (SELECT doc_id, r FROM k UNION ALL SELECT doc_id, r FROM v) GROUP BY doc_id)
SELECT doc_id AS item_id, round(CAST(score AS DOUBLE), 9) AS rrf_score, CASE WHEN s > 0.7 THEN 'EXTRACTED' WHEN s > 0.5 OR 1.0 / k.r > 0.6 OR s > 0.3 OR 1.0 / k.r > 0.3 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence
FROM f LEFT JOIN k USING (doc_id) LEFT JOIN v USING (doc_id) ORDER BY round(score, 12) DESC, doc_id LIMIT 5""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    best = search.bm25(items, "The of in", 10, "item_id")
    keyword = best.select("item_id", F.row_number().over(Window.orderBy(F.round("rank", 9), "item_id")).alias("rank"))  # ten rows
    near = vectors.nearest(vectors.hash_embedding(items, "item_id", "text"), vectors.hash_vector("The of in").tolist(), 10, "item_id")
    vector = near.select("item_id", "score", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "item_id")).alias("rank"))  # ten rows
    return fusion.hybrid(keyword, vector, "item_id", 5).select("item_id", F.round("rrf_score", 9).alias("rrf_score"), "confidence")


@register("""WITH h AS (SELECT doc_id, 0 AS variant FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(lower(text), 'reserved') UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(lower(text), 'nicht'))
SELECT doc_id, min(variant) AS variant FROM h GROUP BY doc_id""")
def search_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = [search.any_word(docs, [w]).select("doc_id", F.col("doc_id").alias("seq")) for w in ("license", "reserved", "nicht")]
    return fusion.united(hits, "doc_id", "seq").select("doc_id", "variant")


@register("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def unseen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return fusion.unseen(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), ["l_suppkey", "l_partkey"])
