"""Registered queries over entities, graphs, timelines and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import communities, entities, graph, partners, timeline, wiki
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


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nations: a supplier's delivers to a customer's, weighted by lines."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s, c = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    d = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return d.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph: users whose events follow each other at once."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    n = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"), F.col("event_type").alias("next_type"))
    return e.join(n, "event_id").where("event_type = 'purchase' AND next_type = 'purchase'").select(F.col("user_id").alias("src"), "dst").distinct()


CHAIN = "chain AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_type = 'purchase' AND b.event_type = 'purchase'), both_ways AS (SELECT src, dst FROM chain WHERE src <> dst UNION SELECT dst, src FROM chain WHERE src <> dst)"
TRADE = "trade AS (SELECT s_nationkey AS src, c_nationkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@register(f"WITH RECURSIVE {CHAIN}, r(node, distance) AS (SELECT 5::BIGINT, 0 UNION SELECT dst, distance + 1 FROM r JOIN both_ways ON node = src WHERE distance < 2) SELECT node, min(distance) AS distance FROM r GROUP BY node")
def bfs_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.within(_chain(spark, sf_dir), spark.createDataFrame([(5,)], "node long"), 2)


@register(f"WITH RECURSIVE {CHAIN}, r(node, path) AS (SELECT 5::BIGINT, [5::BIGINT] UNION ALL SELECT dst, list_append(path, dst) FROM r JOIN both_ways ON node = src WHERE len(path) <= 3 AND NOT list_contains(path, dst)) SELECT path, len(path) - 1 AS hops FROM r WHERE node = 77 ORDER BY len(path), path LIMIT 1")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(_chain(spark, sf_dir), 5, 77, 3).select("path", F.col("hops").cast("long").alias("hops"))


@register(f"WITH RECURSIVE {CHAIN}, r(node, seen) AS (SELECT DISTINCT src, src FROM both_ways UNION SELECT r.node, b.dst FROM r JOIN both_ways b ON r.seen = b.src) SELECT node, min(seen) AS component FROM r GROUP BY node")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_chain(spark, sf_dir))


@register()
def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(_trade(spark, sf_dir))


@register()
def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events follow each other, weighted by how often; SQL cannot express the rounds, see the tests."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("src"))
    n = e.select((F.col("event_id") - 1).alias("event_id"), F.col("src").alias("dst"))
    edges = e.join(n, "event_id").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return communities.louvain(edges, table(spark, sf_dir, "events").select(F.col("user_id").alias("node")))


@register(f"""WITH {TRADE}, e AS (SELECT src, dst, weight FROM trade WHERE src <> dst UNION ALL SELECT dst, src, weight FROM trade WHERE src <> dst UNION ALL SELECT src, dst, 2 * weight FROM trade WHERE src = dst),
c AS (SELECT a.n_regionkey AS x, b.n_regionkey AS y, weight FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst),
s AS (SELECT x, sum(weight) AS d, sum(CASE WHEN x = y THEN weight ELSE 0 END) AS i FROM c GROUP BY x)
SELECT round(sum(i) / sum(d) - sum(d * d) / sum(d) / sum(d), 9) AS modularity FROM s""")
def region_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("community"))
    return communities.modularity(_trade(spark, sf_dir), of).select(F.round("modularity", 9).alias("modularity"))


@register("SELECT a.s AS src, b.s AS dst, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) b USING (l_orderkey) WHERE a.s < b.s GROUP BY ALL")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@register(f"""WITH {CHAIN}, deg AS (SELECT src AS via, count(*) AS d FROM both_ways GROUP BY src HAVING count(*) > 1),
cm AS (SELECT a.dst AS src, b.dst AS dst, sum(1 / ln(d)) AS aa FROM both_ways a JOIN both_ways b ON a.src = b.src AND a.dst < b.dst JOIN deg ON deg.via = a.src GROUP BY ALL),
dr AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(count(*) AS DOUBLE) AS w FROM chain WHERE src <> dst GROUP BY ALL)
,m AS (SELECT DISTINCT user_id AS name, strftime(ts, '%Y-%m-%d') AS doc FROM events WHERE event_type = 'error'), z AS (SELECT name, count(*) AS n FROM m GROUP BY name),
sh AS (SELECT x.name AS src, y.name AS dst, count(*) / least(any_value(a.n), any_value(b.n)) AS shared FROM m x JOIN m y ON x.doc = y.doc AND x.name < y.name JOIN z a ON a.name = x.name JOIN z b ON b.name = y.name GROUP BY ALL)
SELECT src, dst, round(coalesce(aa, 0), 6) AS adamic_adar, round(coalesce(shared, 0), 6) AS shared, round(CAST(least(1.0, greatest(CASE WHEN w IS NULL THEN 0.0 ELSE least(0.3 + 0.1 * w, 0.8) END, least(coalesce(aa, 0) / 5, 0.6), 0.7 * coalesce(shared, 0))) AS DOUBLE), 6) AS affinity FROM dr FULL JOIN cm USING (src, dst) FULL JOIN sh USING (src, dst)""")
def affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("doc"))
    d = graph.affinity(_chain(spark, sf_dir).withColumn("weight", F.lit(1.0)), days)
    # none is below 0: rounded by arithmetic, as round() goes by way of decimals, which takes as long as all else
    return d.select("src", "dst", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("adamic_adar", "shared", "affinity")])


@register("SELECT 'R' || r_regionkey AS id, NULL AS parent_id, r_name AS title, 0 AS depth, r_name AS path, false AS is_leaf FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 1, r_name || '/' || n_name, true FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"))
    return graph.tree(r.unionByName(n), F.col("parent_id").isNull())


@register("""WITH e AS (SELECT o_orderpriority AS name, count(*) AS mentions FROM orders GROUP BY 1), g AS (SELECT o_orderpriority AS src, o_orderstatus AS dst FROM orders),
c AS (SELECT name, count(*) AS connections FROM (SELECT src AS name FROM g UNION ALL SELECT dst FROM g) GROUP BY name)
SELECT name, mentions, coalesce(connections, 0) AS connections, mentions + 2 * coalesce(connections, 0) AS score, CAST(row_number() OVER (ORDER BY mentions + 2 * coalesce(connections, 0) DESC, name) AS INT) AS rank FROM e LEFT JOIN c USING (name)""")
def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return graph.ranked_concepts(o.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("mentions")), o.select(F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("dst")))


MENTION_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '人物' WHEN 2 THEN 'org' ELSE 'Gadget' END"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each line of a document, as a mention."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    name = F.regexp_extract("t", r"^([A-Za-z]+)", 1)
    d = d.select("doc_id", "line", F.col("source").alias("kb_id"), name.alias("name"), F.concat("doc_id", F.lit("_chunk_"), "line").alias("chunk_id"), F.length("t").alias("importance")).where("name != ''")
    kind = F.expr(MENTION_TYPE)
    return d.select("*", (F.col("doc_id") * 100_000 + F.col("line")).alias("seq"), kind.alias("type"), F.create_map(F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string")), F.col("line").cast("string")).alias("attributes"))


MENTIONS = "m AS (SELECT doc_id, source AS kb_id, line, regexp_extract(t, '^([A-Za-z]+)', 1) AS name, length(t) AS importance FROM (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE regexp_extract(t, '^([A-Za-z]+)', 1) <> '')"


@register(f"""WITH {MENTIONS}, g AS (SELECT kb_id, lower(name) AS k, min(name) AS name, max(importance) AS importance, count(*) AS n_mentions, count(DISTINCT name) AS n_aliases, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY ALL),
t AS (SELECT kb_id, lower(name) AS k, 'a' || doc_id % 3 AS a, CAST(arg_max(line, doc_id * 100000 + line) AS VARCHAR) AS v FROM m GROUP BY ALL), ts AS (SELECT kb_id, k, string_agg(a || '=' || v, ',' ORDER BY a) AS attributes FROM t GROUP BY ALL)
SELECT kb_id, printf('entity_%04d', row_number() OVER (PARTITION BY kb_id ORDER BY k)) AS entity_id, name, CAST(importance AS INT) AS importance, n_mentions, n_aliases, n_docs, attributes FROM g JOIN ts USING (kb_id, k)""")
def entity_merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return entities.merge_exact(_mentions(spark, sf_dir)).withColumn("attributes", F.array_join(pairs, ","))


@register(f"WITH {MENTIONS} SELECT kb_id, lower(name) AS key, count(DISTINCT (name, doc_id)) AS members FROM m GROUP BY ALL")
def entity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.exact_members(_mentions(spark, sf_dir)).groupBy("kb_id", "key").agg(F.count("*").alias("members"))


@register()
def entity_merge_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).select("kb_id", "seq", "name", "type", F.array("chunk_id").alias("chunks"), "attributes")
    found, aliases, chunks = entities.merge_greedy(m)
    aliases = aliases.groupBy("kb_id", "name").agg(F.count("*").alias("aliases"))
    chunks = chunks.groupBy("kb_id", "name").agg(F.count("*").alias("chunks"))
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return found.join(aliases, ["kb_id", "name"], "left").join(chunks, ["kb_id", "name"]).select("kb_id", "name", "type", "n_aliases", "mention_count", "chunks", F.array_join(pairs, ",").alias("attributes"))


@register(f"WITH {MENTIONS} SELECT name, count(DISTINCT doc_id) AS document_count FROM m GROUP BY name HAVING count(DISTINCT doc_id) > 1")
def cross_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.cross_references(_mentions(spark, sf_dir))


@register("""WITH v AS (SELECT md5(text) AS name, lower(replace(trim(source), ' ', '')) AS norm, min(source) AS value, count(*) AS c FROM documents GROUP BY ALL)
SELECT name, 'source_location' AS attribute, count(*) AS n_values, CAST(least(1.0, round(0.5 + 0.1 * count(*), 9)) AS DOUBLE) AS confidence FROM v GROUP BY name HAVING count(*) > 1""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("name"), F.create_map(F.lit("source_location"), F.col("source"), F.lit("checksum"), F.col("lang")).alias("attributes"))
    return entities.contradictions(d).select("name", "attribute", "n_values", "confidence")


@register("SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def isolated_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("subject"), (-F.col("l_suppkey") - 1).alias("object"))
    return entities.isolated(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name")), r)


@register("""WITH e AS (SELECT p_partkey AS name, p_size / 50.0 AS confidence FROM part), r AS (SELECT DISTINCT l_partkey FROM lineitem)
SELECT (SELECT count(*) FROM e) AS entities, (SELECT CAST(round(avg(confidence), 6) AS DOUBLE) FROM e) AS avg_confidence, (SELECT count(*) FROM lineitem) AS relations, (SELECT count(*) FROM e WHERE name NOT IN (SELECT l_partkey FROM r)) AS isolated, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS high_severity, true AS passed""")
def extraction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    severe = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("severity"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject"), (-F.col("l_suppkey") - 1).alias("object"))
    return entities.extraction_gate(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") / 50.0).alias("confidence")), r, severe)


@register("SELECT count(*) FILTER (l_discount * 10 >= 0.8) AS high, count(*) FILTER (l_discount * 10 >= 0.5 AND l_discount * 10 < 0.8) AS medium, count(*) FILTER (l_discount * 10 < 0.5) AS low FROM lineitem")
def surprise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.surprise_counts(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("score")))


@register("SELECT l_returnflag AS kind, count(*) FILTER (l_discount * 10 >= 0.8) AS high, count(*) FILTER (l_discount * 10 >= 0.5 AND l_discount * 10 < 0.8) AS medium, count(*) FILTER (l_discount * 10 < 0.5) AS low FROM lineitem GROUP BY 1")
def surprise_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.surprise_counts(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), (F.col("l_discount") * 10).alias("score")), by_type=True)


@register("SELECT event_id, user_id FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-05' AND strftime(ts, '%Y-%m-%d') <= '2024-01-1' AND event_type IN ('click', 'purchase')")
def timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.array("event_type").alias("people"))
    return timeline.between(e, "date", "2024-01-05", "2024-01-1", "people", ["click", "purchase"]).select("event_id", "user_id")


@register("SELECT date, event_id FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY length(props) DESC, event_id) AS r FROM events) WHERE r = 1")
def timeline_best_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.best_per_date(table(spark, sf_dir, "events").select("event_id", "props", F.date_format("ts", "yyyy-MM-dd").alias("date")), "date", "props", "event_id").select("date", "event_id")


LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages)"""
PATHS = "paths AS (SELECT page_id, '/' || regexp_extract(url, '([^/?#.]+)(?:\\.html|/|\\?.*|#.*)?$', 1) AS path FROM pages)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", r"([^/?#.]+)(?:\.html|/|\?.*|#.*)?$", 1)).alias("path"))


@register(f"WITH {LINKS} SELECT page_id, target, count(*) AS n FROM links GROUP BY ALL")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.html_links(table(spark, sf_dir, "pages"), "page_id", "html").groupBy("page_id", "target").agg(F.count("*").alias("n"))


@register(f"WITH {LINKS}, {PATHS} SELECT page_id, target FROM links WHERE target NOT IN (SELECT path FROM paths)")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.broken(wiki.html_links(table(spark, sf_dir, "pages"), "page_id", "html"), _paths(spark, sf_dir), "target", "path").select("page_id", "target")


# Parts as pages: a part links to the one its supplier's number points to, if it is cheap; a target may be missing.
PART_LINKS = "plinks AS (SELECT CAST(ps.p_partkey AS VARCHAR) AS source, CAST(ps.p_partkey * 7 % 400 AS VARCHAR) AS target FROM part ps WHERE p_size < 15), ppages AS (SELECT CAST(p_partkey AS VARCHAR) AS page FROM part)"


def _part_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") < 15, F.concat(F.lit("see\n[["), (F.col("p_partkey") * 7 % 400).cast("string"), F.lit("|it]]"))).otherwise("no link")
    pages = p.select(F.col("p_partkey").cast("string").alias("page"), text.alias("text"))
    return pages.select("page"), wiki.page_links(pages, "page", "text").withColumnRenamed("page", "source")


@register(f"WITH {PART_LINKS} SELECT page FROM ppages WHERE page NOT IN (SELECT source FROM plinks) AND page NOT IN (SELECT target FROM plinks)")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, links = _part_links(spark, sf_dir)
    return wiki.orphans(pages, links, "page", "source", "target")


@register("SELECT concat_ws(' ', p_brand, p_size) AS kind, count(*) AS n FROM part GROUP BY 1 HAVING count(*) < 3")
def sparse_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.sparse_types(table(spark, sf_dir, "part").withColumn("kind", F.concat_ws(" ", "p_brand", "p_size")), "kind")


@register(f"""WITH {PART_LINKS}, o AS (SELECT count(*) AS n FROM ppages WHERE page NOT IN (SELECT source FROM plinks) AND page NOT IN (SELECT target FROM plinks) AND CAST(page AS INT) % 50 = 0),
b AS (SELECT count(*) AS n FROM plinks WHERE target NOT IN (SELECT page FROM ppages) AND CAST(target AS INT) % 67 = 0), t AS (SELECT count(*) AS n FROM (SELECT p_brand FROM part WHERE p_partkey <= 60 GROUP BY 1 HAVING count(*) < 3)), l AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity < 2))
SELECT o.n AS orphans, t.n AS sparse, b.n AS broken, l.n AS lonely, CAST(round(greatest(0.0, 1 - 0.05 * o.n - 0.03 * t.n - 0.08 * b.n - 0.02 * l.n), 4) AS DOUBLE) AS score FROM o, b, t, l""")
def wiki_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, links = _part_links(spark, sf_dir)
    lonely = entities.isolated(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name")), table(spark, sf_dir, "lineitem").where("l_quantity < 2").select(F.col("l_suppkey").alias("subject"), F.lit(-1).cast("long").alias("object")))
    orphans = wiki.orphans(pages, links, "page", "source", "target").where("CAST(page AS INT) % 50 = 0")
    gone = wiki.broken(links, pages, "target", "page").where("CAST(target AS INT) % 67 = 0")
    return wiki.health(orphans, wiki.sparse_types(table(spark, sf_dir, "part").where("p_partkey <= 60"), "p_brand"), gone, lonely)


@register("SELECT page_id, 2 AS line_no, regexp_extract(url, '://([^/]*)', 1) AS target, CASE WHEN page_id % 2 = 0 THEN 'shown ' || page_id ELSE regexp_extract(url, '://([^/]*)', 1) END AS display FROM pages")
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("|shown "), F.col("page_id").cast("string"))).otherwise("")
    t = F.concat(F.lit("first\nsee [["), F.regexp_extract("url", "://([^/]*)", 1), shown, F.lit("]] and [no] more"))
    return wiki.page_links(table(spark, sf_dir, "pages").select("page_id", t.alias("t")), "page_id", "t").select("page_id", "line_no", "target", "display")


@register("SELECT kind, id, title, count(*) OVER () AS total FROM (SELECT 'entity' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS title FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12') UNION ALL SELECT 'catalog', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE contains(lower(n_name), '12')) ORDER BY kind DESC, id LIMIT 20")
def wiki_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attributes"))
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("description"))
    return wiki.search(e, c, "12", 20)


FOLLOWS = """follows AS (SELECT least(a.user_id, b.user_id) AS src, greatest(a.user_id, b.user_id) AS dst, CAST(count(*) AS DOUBLE) AS w FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id GROUP BY ALL),
f2 AS (SELECT src, dst, w FROM follows UNION ALL SELECT dst, src, w FROM follows), fd AS (SELECT src AS via, count(*) AS d FROM f2 GROUP BY src HAVING count(*) > 1),
fc AS (SELECT a.dst AS src, b.dst AS dst, sum(1 / ln(d)) AS aa FROM f2 a JOIN f2 b ON a.src = b.src AND a.dst <> b.dst JOIN fd ON via = a.src GROUP BY ALL)"""


def _follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events follow each other, weighted by how often."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("src"))
    n = e.select((F.col("event_id") - 1).alias("event_id"), F.col("src").alias("dst"))
    return e.join(n, "event_id").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


@register(f"""WITH {FOLLOWS}, s AS (SELECT src, dst, coalesce(aa, 0) AS aa, greatest(CASE WHEN w IS NULL THEN 0.0 ELSE least(0.3 + 0.1 * w, 0.8) END, least(coalesce(aa, 0) / 5, 0.6)) AS a FROM f2 FULL JOIN fc USING (src, dst))
SELECT src AS name, dst AS partner, round(aa, 6) AS adamic_adar, round(CAST(a AS DOUBLE), 6) AS affinity, CAST(row_number() OVER (PARTITION BY src ORDER BY round(CAST(a AS DOUBLE), 9) DESC, dst) AS INT) AS position FROM s QUALIFY position <= 5""")
def best_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = partners.best_partners(_follows(spark, sf_dir), 5)
    return d.select("name", "partner", F.round("adamic_adar", 6).alias("adamic_adar"), F.round("affinity", 6).alias("affinity"), "position")


@register(f"""WITH {FOLLOWS}, p AS (SELECT DISTINCT least(user_id, user_id * 7 % 100 + 1) AS src, greatest(user_id, user_id * 7 % 100 + 1) AS dst FROM events WHERE user_id <> user_id * 7 % 100 + 1),
m AS (SELECT DISTINCT user_id AS name, strftime(ts, '%Y-%m-%d') AS doc FROM events), z AS (SELECT name, count(*) AS n FROM m GROUP BY name),
b AS (SELECT p.src, p.dst, count(*) AS n_both FROM p JOIN m x ON x.name = p.src JOIN m y ON y.name = p.dst AND x.doc = y.doc GROUP BY ALL),
s AS (SELECT p.src, p.dst, w, coalesce(aa, 0) AS aa, coalesce(n_both / least(zx.n, zy.n), 0) AS shared FROM p LEFT JOIN follows USING (src, dst) LEFT JOIN fc USING (src, dst) LEFT JOIN b USING (src, dst) LEFT JOIN z zx ON zx.name = p.src LEFT JOIN z zy ON zy.name = p.dst)
SELECT src, dst, round(aa, 6) AS adamic_adar, round(shared, 6) AS shared, round(CAST(least(1.0, greatest(CASE WHEN w IS NULL THEN 0.0 ELSE least(0.3 + 0.1 * w, 0.8) END, least(aa / 5, 0.6), 0.7 * shared)) AS DOUBLE), 6) AS affinity FROM s""")
def affinity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user with one of a hundred others, scored by edges, common neighbours and common days."""
    e = table(spark, sf_dir, "events")
    asked = e.select(F.col("user_id").alias("src"), (F.col("user_id") * 7 % 100 + 1).alias("dst"))
    days = e.select(F.col("user_id").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("doc"))
    d = partners.affinity_of(asked, _follows(spark, sf_dir), days)
    return d.select("src", "dst", *[F.round(c, 6).alias(c) for c in ("adamic_adar", "shared", "affinity")])
