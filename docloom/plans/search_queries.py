"""Registered queries over documents and vectors, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, fusion, search, vectors
from docloom.operators import vector_blocks as vector_index
from docloom.operators.ordering import checkpoint_folder, checkpointed, numbered, removed
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


TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def bm25_sql(table: str, key: str, terms: list[str]) -> str:
    """The ten best rows of a table that hold all terms, as SQL."""
    words = ", ".join(f"'{t}'" for t in terms)
    return BM25.replace("documents", table).replace("doc_id", key).replace("'the', 'was', 'with'", words).replace("terms = 3", f"terms = {len(terms)}")


BM25 = rf"""
tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, coalesce(len({TOKENS}), 0) AS n FROM documents),
st AS (SELECT count(*) AS n_all, avg(n) AS avg_n FROM dl),
df AS (SELECT term, greatest(1e-6, ln((n_all - count(*) + 0.5) / (count(*) + 0.5))) AS idf, any_value(avg_n) AS avg_n FROM tf, st WHERE term IN ('the', 'was', 'with') GROUP BY term, n_all),
scored AS (SELECT doc_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))) AS rank, count(*) AS terms FROM tf JOIN df USING (term) JOIN dl USING (doc_id) GROUP BY doc_id),
best AS (SELECT doc_id, rank FROM scored WHERE terms = 3 ORDER BY round(rank, 9), doc_id LIMIT 10)"""


@register(f"WITH {BM25} SELECT doc_id, round(rank, 6) AS rank, d.text[:200] AS snippet, round(1 / (1 + exp(-((rank + 10) / 3.5))), 6) AS relevance FROM best JOIN documents d USING (doc_id)")
def keyword_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    best = search.bm25(docs, "The was with", 10)
    rows = docs.select("doc_id", F.substring("text", 1, 200).alias("snippet")).join(F.broadcast(best), "doc_id")  # ten rows
    return rows.select("doc_id", F.round("rank", 6).alias("rank"), "snippet", F.round(fusion.relevance("L1", F.col("rank")), 6).alias("relevance"))


@register("SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + TOKENS + ") AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@register("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'stone') OR contains(lower(text), 'license') OR contains(lower(text), 'nicht')")
def keyword_like_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.any_word(table(spark, sf_dir, "documents"), ["stone", "License", "nicht"]).select("doc_id", "source")


@register("""
WITH m AS (SELECT doc_id, text, strpos(lower(text), 'license') - 1 AS a FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'under')),
s AS (SELECT *, greatest(0, a - 100) AS b FROM m)
SELECT doc_id, CASE WHEN b > 0 THEN '...' ELSE '' END || substr(text, b + 1, 300) || CASE WHEN b + 300 < length(text) THEN '...' ELSE '' END AS snippet FROM s""")
def raw_search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.all_words(table(spark, sf_dir, "documents"), "License under").select("doc_id", "snippet")


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


@register(rf"""
WITH {LINES}, m AS (SELECT doc_id, line_no, line, regexp_extract(line, '(?i)licen[sc]e', 0) AS match FROM lines WHERE regexp_matches(line, '(?i)licen[sc]e')),
p AS (SELECT *, strpos(lower(line), lower(match)) - 1 AS a FROM m), q AS (SELECT *, greatest(0, a - 80) AS b, a + length(match) + 80 AS e FROM p)
SELECT doc_id, CAST(line_no AS INT) AS line_no, match, CASE WHEN b > 0 THEN '...' ELSE '' END || substr(line, b + 1, e - b) || CASE WHEN e < length(line) THEN '...' ELSE '' END AS context FROM q""")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(table(spark, sf_dir, "documents"), "licen[sc]e")


@register(rf"""
WITH {LINES}, w AS (SELECT doc_id, line_no, line, lag(line[:200]) OVER o AS p, lead(line[:200]) OVER o AS n FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, CAST(line_no AS INT) AS line_no, line[:300] AS line, coalesce(p, '') AS before, coalesce(n, '') AS after FROM w WHERE regexp_matches(line, '(?i)reserved')""")
def grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep_with_lines(table(spark, sf_dir, "documents"), "reserved", 1)


@register(rf"""
WITH {LINES}, w AS (SELECT doc_id, line_no, line, lag(line[:200]) OVER o AS p, lead(line[:200]) OVER o AS n FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
h AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, line[:300] AS line, coalesce(p, '') AS before, coalesce(n, '') AS after FROM w WHERE regexp_matches(line, '(?i)reserved|licen[sc]e'))
SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY doc_id, line_no OFFSET 5 LIMIT 20""")
def grep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep_page(table(spark, sf_dir, "documents"), "reserved|licen[sc]e", 1, 5, 20)


@register(rf"WITH {LINES} SELECT DISTINCT doc_id FROM lines WHERE regexp_matches(line, '(?i)version [0-9]')")
def grep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.files_with_matches(table(spark, sf_dir, "documents"), "version [0-9]")


@register("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS total_lines, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS text FROM documents")
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.read_lines(table(spark, sf_dir, "documents"), 2, 3)


@register(r"SELECT doc_id, CAST(floor(1.3 * len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS INT) AS tokens, CAST(floor(0.25 * length(text)) AS INT) AS context_tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.context_token_estimate(F.col("text")).alias("context_tokens"))


@register()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), paragraph="\n")


def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register(rf"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, (lag(line) OVER o)[:100] AS previous, (lead(line) OVER o)[:100] AS next FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)")
def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.neighbours(_line_chunks(spark, sf_dir), "doc_id", "line_no", "line")


@register("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT n_regionkey, CAST(floor(i / 3) AS BIGINT) AS batch, count(*) AS n_rows,
       '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY i) AS content FROM n GROUP BY n_regionkey, floor(i / 3)""")
def row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.row_batches(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"], 3)


# The hash embedding in SQL: gram and word counts, places by bytes of their MD5 (256 places, so one byte each).
def _byte(at: int) -> str:
    return f"((strpos('0123456789abcdef', h[{at}]) - 1) * 16 + strpos('0123456789abcdef', h[{at + 1}]) - 1)"


EMBEDDED = f"""texts AS (SELECT item_id AS doc_id, coalesce(text, '') AS t FROM benchmark),
gr AS (SELECT doc_id, substr(t, i, n) AS g, count(*) AS c FROM (SELECT doc_id, t, n, unnest(range(1, greatest(1, length(t) - n + 1) + 1)) AS i FROM texts, (VALUES (2), (3), (4)) AS ns(n)) GROUP BY ALL),
wd AS (SELECT doc_id, lower(w) AS w, count(*) AS c FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS w FROM texts) GROUP BY ALL),
hs AS (SELECT doc_id, md5(g) AS h, c, 0 AS k FROM gr UNION ALL SELECT doc_id, md5(w), c, 1 FROM wd),
vs AS (SELECT doc_id, {_byte(1)} AS dim, CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END * c AS x FROM hs UNION ALL SELECT doc_id, {_byte(9)}, -0.5 * c FROM hs WHERE k = 0),
ds AS (SELECT doc_id, dim, CAST(sum(x) AS DOUBLE) AS x FROM vs GROUP BY ALL),
emb AS (SELECT doc_id, dim, CAST(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS FLOAT) AS value FROM ds)"""


def embedded_query(text: str) -> str:
    """The vector of a question as SQL values (place, weight)."""
    return ", ".join(f"({i}, {float(x)!r}::DOUBLE)" for i, x in enumerate(vectors.hash_vector(text)))


def _embedded(rows: DataFrame, key: str) -> DataFrame:
    """The filled places of each row's vector and a weighted sum of it."""
    v = vectors.hash_embedding(rows, key, "text")
    total = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select(key, F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("filled"), F.round(total, 4).alias("checksum"))


@register()
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents; SQL takes a minute for a thousand of them, so a test compares it with a plain loop."""
    return _embedded(table(spark, sf_dir, "documents"), "doc_id")


@register(f"WITH {EMBEDDED} SELECT doc_id AS item_id, count(*) FILTER (value <> 0) AS filled, CAST(round(sum(CAST(value AS DOUBLE) * (dim + 1)), 4) AS DOUBLE) AS checksum FROM emb GROUP BY doc_id")
def hash_embed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(table(spark, sf_dir, "benchmark"), "item_id")


COSINE = "list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"


@register(f"SELECT v.vec_id, v.label, round({COSINE}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY round({COSINE}, 9) DESC, v.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    query = v.where("vec_id = 7").select("embedding").first()[0]
    return vectors.nearest(v, query, 10).select("vec_id", "label", F.round("score", 6).alias("score"))


@register(f"SELECT v.vec_id, round({COSINE}, 6) AS score, CAST(row_number() OVER (ORDER BY round({COSINE}, 9) DESC, v.vec_id) AS INT) AS position FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q QUALIFY position <= 20")
def vector_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written in blocks, of which a search reads those that may hold one of the best."""
    v = table(spark, sf_dir, "embeddings")
    folder = f"{checkpoint_folder(spark)}/blocks_{uuid.uuid4().hex}"
    try:
        vector_index.write_blocks(v, folder)
        found, _ = vector_index.nearest_in_blocks(spark, folder, v.where("vec_id = 7").select("embedding").first()[0], 20)
        found = checkpointed(found)
    finally:
        removed(spark, folder)
    return found.select("vec_id", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "vec_id")).alias("position"))  # 20 rows


@register(f"WITH s AS (SELECT q.vec_id AS query, v.vec_id, {COSINE} AS s FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) AS position FROM s) SELECT query, vec_id, round(s, 6) AS score, CAST(position AS INT) AS position FROM r WHERE position <= 5")
def vector_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    found = vectors.nearest_to_many(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("long").alias("query"), "embedding"), 5)
    return found.select("query", "vec_id", F.round("score", 6).alias("score"), "position")


def _ranked(rows: DataFrame, order: list, n: int) -> DataFrame:
    best = rows.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows


def _longest_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and harmless documents first, the longest of them, so that the two lists share keys."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return _ranked(d, [F.desc("quality"), F.col("toxic"), F.desc("n_chars"), F.col("doc_id")], 20).withColumn("score", F.col("quality") + (1 - F.col("toxic")) / F.lit(2.0))


RANKED = """a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, n_chars * 1.0 AS score FROM documents QUALIFY rank <= 20),
b AS (SELECT doc_id, row_number() OVER (ORDER BY quality DESC, toxic, n_chars DESC, doc_id) AS rank, quality + (1 - toxic) / 2.0 AS score FROM labels JOIN documents USING (doc_id) QUALIFY rank <= 20)"""


@register(f"WITH {RANKED} SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, CASE WHEN bool_or(l = 0) THEN 'documents' ELSE 'labels' END AS won FROM (SELECT doc_id, rank, 0 AS l FROM a UNION ALL SELECT doc_id, rank, 1 FROM b) GROUP BY doc_id")
def rrf_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _ranked(table(spark, sf_dir, "documents"), [F.desc("n_chars"), F.col("doc_id")], 20)
    b = _longest_good(spark, sf_dir)
    both = fusion.fuse([a.withColumn("won", F.lit("documents")), b.withColumn("won", F.lit("labels"))], "doc_id", item="won")
    return both.select("doc_id", F.round("rrf_score", 9).alias("rrf_score"), "won")


@register(f"WITH {RANKED}, u AS (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b) SELECT count(*) AS inputs, count(DISTINCT doc_id) AS merged, 1 - count(DISTINCT doc_id) / count(*) AS overlap_ratio FROM u")
def rrf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _ranked(table(spark, sf_dir, "documents"), [F.desc("n_chars"), F.col("doc_id")], 20)
    b = _longest_good(spark, sf_dir)
    return fusion.fusion_metrics([a, b], "doc_id")


@register(f"WITH {RANKED}, u AS (SELECT doc_id, rank, score, 3.0 AS w, 'vector' AS s FROM a UNION ALL SELECT doc_id, rank, score, 2.0, 'keyword' FROM b) SELECT doc_id, round(sum(w / (60 + rank)), 9) AS rrf_score, CAST(max(CASE WHEN s = 'vector' THEN score END) AS DOUBLE) AS vector_score, CAST(max(CASE WHEN s = 'keyword' THEN score END) AS DOUBLE) AS keyword_score FROM u GROUP BY doc_id ORDER BY round(sum(w / (60 + rank)), 12) DESC, doc_id LIMIT 20")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _ranked(table(spark, sf_dir, "documents"), [F.desc("n_chars"), F.col("doc_id")], 20).select(F.lit("vector").alias("signal"), "doc_id", "rank", F.col("n_chars").cast("double").alias("score"))
    b = _longest_good(spark, sf_dir).select(F.lit("keyword").alias("signal"), "doc_id", "rank", "score")
    return fusion.fuse_weighted(a.unionByName(b), "doc_id").select("doc_id", F.round("rrf_score", 9).alias("rrf_score"), "vector_score", "keyword_score")


@register("SELECT doc_id, round(CAST(n_chars AS DOUBLE) * CASE WHEN doc_id % 2 = 0 THEN 1.1 ELSE 1.0 END * CASE WHEN lang = 'en' THEN 1.1 ELSE 1.0 END * CASE WHEN row_number() OVER (PARTITION BY text[:100] ORDER BY doc_id) > 1 THEN 0.95 ELSE 1.0 END, 4) AS final_score FROM documents")
def rerank_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("recent", F.col("doc_id") % 2 == 0).withColumn("authoritative", F.col("lang") == "en")
    return fusion.rerank(docs, "n_chars", "doc_id", "text").select("doc_id", F.round("final_score", 4).alias("final_score"))


CONFIDENCE = "CASE WHEN toxic = 1 THEN 'EXTRACTED' WHEN quality * 0.6 > 0.7 THEN 'EXTRACTED' WHEN quality * 0.6 > 0.5 OR doc_id % 10 / 10.0 > 0.6 THEN 'INFERRED' WHEN quality * 0.6 > 0.3 OR doc_id % 10 / 10.0 > 0.3 THEN 'INFERRED' ELSE 'AMBIGUOUS' END"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = fusion.confidence(F.col("quality") * 0.6, F.col("doc_id") % 10 / 10.0, exact=F.col("toxic") == 1)
    return table(spark, sf_dir, "labels").select("doc_id", "quality", label.alias("confidence"))


@register(f"SELECT doc_id, {CONFIDENCE} AS confidence FROM labels")
def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("doc_id", "confidence")


@register(f"SELECT quality, count(*) FILTER (c = 'EXTRACTED') AS extracted, count(*) FILTER (c = 'INFERRED') AS inferred, count(*) FILTER (c = 'AMBIGUOUS') AS ambiguous FROM (SELECT quality, {CONFIDENCE} AS c FROM labels) GROUP BY quality")
def confidence_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.confidence_counts(_labelled(spark, sf_dir), "confidence", "quality")


@register(f"SELECT doc_id FROM labels WHERE {CONFIDENCE} IN ('EXTRACTED', 'INFERRED')")
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.at_least(_labelled(spark, sf_dir), "confidence", "INFERRED").select("doc_id")


@register("SELECT doc_id, round(1 / (1 + exp(-(n_chars / 1000.0 - 2))), 6) AS l0, round(1 / (1 + exp(-((10 - n_chars / 500.0) / 3.5))), 6) AS l1, round(greatest(0.0, least(1.0, n_chars / 5000.0)), 6) AS l2, n_chars / 5000.0 < 0.4 AS drill FROM documents")
def relevance_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(fusion.relevance("L0", n / 1000.0), 6).alias("l0"), F.round(fusion.relevance("L1", -n / 500.0), 6).alias("l1"), F.round(fusion.relevance("L2", n / 5000.0), 6).alias("l2"), fusion.drill_down(n / 5000.0).alias("drill"))


@register("SELECT d.doc_id, f.original FROM (SELECT doc_id, md5(text) AS h FROM documents) d JOIN (SELECT md5(text) AS h, min(doc_id) AS original FROM documents GROUP BY 1) f USING (h) WHERE d.doc_id <> f.original")
def doc_dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.sources.files import duplicates

    return duplicates(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id", "digest")


@register("WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, source FROM documents) SELECT source, doc_id FROM r WHERE n <= 20 OR i % greatest(1, CAST(floor(n / floor(0.2 * n)) AS BIGINT)) = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "i").withColumn("i", F.col("i") - 1)
    d = d.join(d.groupBy("source").agg(F.count("*").alias("n")), "source")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / F.floor(0.2 * F.col("n"))))
    return d.where((F.col("n") <= 20) | (F.col("i") % step == 0)).select("source", "doc_id")


@register("""
WITH c AS (SELECT doc_id, unnest(range(1, length(text) + 1, 60)) AS p, text FROM documents),
d AS (SELECT doc_id, p, text[p:p + 99] AS body, lag(text[p:p + 99]) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM c)
SELECT doc_id, CAST(p AS INT) AS piece, CAST(coalesce(list_max(list_filter(range(6, least(length(body), length(prev), 500) + 1), lambda n: right(prev, n) = left(body, n))), 0) AS INT) AS overlap FROM d""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chunking.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", 60, 100)
    return chunking.merged(d, "doc_id", "piece", "body").select("doc_id", "piece", F.col("overlap").cast("int").alias("overlap"))


@register("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
f AS (SELECT source FROM r WHERE r = 1 ORDER BY n_chars DESC, doc_id LIMIT 5) SELECT doc_id, source, n_chars FROM r JOIN f USING (source) WHERE r <= 3""")
def evidence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return fusion.evidence(d, "source", [F.desc("n_chars"), F.col("doc_id")]).drop("position")


@register("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id OFFSET 20 LIMIT 10")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 20, 10)


@register("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.first_of_each(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id")


@register("WITH e AS (SELECT doc_id, quality * 2.0 AS score FROM labels), k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS seq FROM documents WHERE contains(lower(text), 'license')) SELECT k.doc_id, row_number() OVER (ORDER BY coalesce(score, 0) DESC, seq) AS position FROM k LEFT JOIN e USING (doc_id)")
def two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.any_word(table(spark, sf_dir, "documents"), ["license"]).select("doc_id", F.col("doc_id").alias("seq"))
    return fusion.two_stage(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2.0).alias("score")), hits).select("doc_id", "position")


@register("SELECT t AS term, count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) >= 2 AS confirmed FROM (VALUES ('License'), ('reserved'), ('nowhere_at_all')) AS x(t) LEFT JOIN documents ON contains(text, t) GROUP BY t")
def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.operators.conversation import claim_check as check

    return check("License, reserved, nowhere_at_all.", table(spark, sf_dir, "documents"), "doc_id", "text")


@register(rf"""
WITH {LINES}, h AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(trim(line), '^All rights') THEN trim(line) END AS name FROM lines),
e AS (SELECT doc_id, max(line_no) AS "end", min(line_no) AS b, count(name) AS k FROM h GROUP BY doc_id),
n AS (SELECT h.doc_id, name, line_no AS "first", coalesce(lead(line_no) OVER (PARTITION BY h.doc_id ORDER BY line_no) - 1, e."end") AS "last" FROM h JOIN e USING (doc_id) WHERE name IS NOT NULL),
p AS (SELECT doc_id, "end", unnest(range(b, "end" + 1, 10)) AS "first" FROM e WHERE k = 0)
SELECT doc_id, name, CAST("first" AS INT) AS "first", CAST("last" AS INT) AS "last" FROM n
UNION ALL SELECT doc_id, '#' || "first" || ' - #' || least("first" + 9, "end"), CAST("first" AS INT), CAST(least("first" + 9, "end") AS INT) FROM p""")
def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chapters(_line_chunks(spark, sf_dir), "doc_id", "line_no", "line", "^All rights", size=10)
