"""Registered queries over tables, logs and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import assess, conversation, tabular
from docloom.operators.ordering import checkpoint_folder, checkpointed, removed
from docloom.sources.tables import table
from docloom.streaming import incremental, session_state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@register("SELECT l_shipmode AS value, n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, value LIMIT 15")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.group_counts(table(spark, sf_dir, "lineitem").withColumn("status", F.concat("l_returnflag", "l_linestatus")), "status")


@register("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_size = 10 GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def group_count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.group_counts(table(spark, sf_dir, "part"), "p_brand", where=F.col("p_size") == 10)


@register("""
WITH p AS (SELECT p_brand AS "group", p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL AND p_type <> '' GROUP BY ALL ORDER BY n DESC, "group", value LIMIT 75),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY "group") AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY "group" ORDER BY n DESC, value) AS INT) AS position FROM p)
SELECT "group", total, value, n, position FROM r WHERE position <= 5""")
def group_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.breakdown(table(spark, sf_dir, "part"), "p_brand", "p_type")


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PROFILE = """
c AS (SELECT column_name AS "column", trim(coalesce(v, '')) AS value FROM (UNPIVOT (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer) ON COLUMNS(*) INTO NAME column_name VALUE v)),
f AS (SELECT "column", count(*) AS n_rows, count(*) FILTER (value = '') AS null_count, count(DISTINCT value) FILTER (value <> '') AS unique_count,
      count(*) FILTER (lower(value) IN ('true', 'false', '1', '0')) AS b, count(*) FILTER (try_cast(replace(value, ',', '') AS DOUBLE) IS NOT NULL) AS x, bool_or(try_cast(value AS DOUBLE) IS NOT NULL AND contains(value, '.')) AS point FROM c GROUP BY 1),
profile AS (SELECT "column", n_rows, null_count, unique_count, CASE WHEN n_rows = null_count THEN 'empty' WHEN b > 0.8 * (n_rows - null_count) THEN 'boolean' WHEN x > 0.8 * (n_rows - null_count) AND point THEN 'float' WHEN x > 0.8 * (n_rows - null_count) THEN 'integer' ELSE 'string' END AS data_type FROM f)"""


@register(f"WITH {PROFILE} SELECT * FROM profile")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.profile(table(spark, sf_dir, "customer"), CUSTOMER)


@register(f"""WITH {PROFILE} SELECT "column", 'constant' AS finding FROM profile WHERE unique_count = 1 AND n_rows > 5 UNION ALL SELECT "column", 'high_null' FROM profile WHERE null_count > 0.5 * n_rows UNION ALL SELECT "column", 'high_cardinality' FROM profile WHERE unique_count > 0.9 * n_rows AND n_rows > 10""")
def column_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.findings(tabular.profile(table(spark, sf_dir, "customer"), CUSTOMER))


@register(f"""WITH {PROFILE} SELECT "column", unique_count FROM profile WHERE unique_count > 1 AND unique_count < least(500, n_rows * 0.1)""")
def partition_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.partition_advice(tabular.profile(table(spark, sf_dir, "customer"), CUSTOMER))


@register("""
WITH c AS (SELECT 'c_acctbal' AS "column", c_acctbal AS x FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey FROM customer)
SELECT "column", round(avg(x), 2) AS mean, round(median(x), 2) AS median, round(stddev_samp(x), 2) AS std, round(min(x), 2) AS min, round(max(x), 2) AS max FROM c GROUP BY 1""")
def numeric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.numeric_distribution(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


@register("""
WITH c AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part),
n AS (SELECT "column", value, count(*) AS n FROM c WHERE value <> '' GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS t, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INT) AS position FROM n)
SELECT "column", value, n, CAST(round(100.0 * n / t, 1) AS DOUBLE) AS pct, position FROM r WHERE position <= 15""")
def string_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.string_distribution(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@register("""SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders""")
def date_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.date_distribution(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")), ["o_orderdate"])


@register("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def sheet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.table_question(table(spark, sf_dir, "part"), "how many of each type", ["p_type", "p_name"])


@register("SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def kb_doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))  # grouped before the join: less to shuffle
    return n.join(counts, n["n_nationkey"] == counts["c_nationkey"], "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("SELECT max(event_id) + 1 AS next_version FROM events")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg((F.max("event_id") + 1).alias("next_version"))


@register("""WITH d AS (SELECT source AS kb_id, count(*) AS documents FROM documents GROUP BY 1), c AS (SELECT source AS kb_id, sum(len(string_split(text, chr(10)))) AS n FROM documents WHERE lang = 'de' GROUP BY 1),
l AS (SELECT source AS kb_id, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1)
SELECT kb_id, documents, CAST(coalesce(c.n, 0) AS BIGINT) AS n_l2, coalesce(c.n, 0) > 0 AS has_l2, coalesce(l.n, 0) AS n_l1, coalesce(l.n, 0) > 0 AS has_l1, 0 AS n_wiki, false AS has_wiki FROM d LEFT JOIN c USING (kb_id) LEFT JOIN l USING (kb_id)""")
def kb_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("kb_id"), "text")
    chunks = d.where("lang = 'de'").select("kb_id", F.explode(F.split("text", "\n")))
    summaries = d.drop("text").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return assess.kb_states(d, {"l2": chunks, "l1": summaries, "wiki": d.limit(0)})


# ---- conversations and logs


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@register("WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, turn, role FROM t WHERE r <= 4 UNION ALL SELECT conv_id, turn, role FROM conversations WHERE role = 'system'")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.recent_history(_talk(spark, sf_dir).select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@register("WITH f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, CASE WHEN length(t) > 20 THEN t[:20] || '...' ELSE t END AS title FROM f")
def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.titles(_talk(spark, sf_dir), "conv_id", "turn", "role", "text")


@register("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS r FROM conversations) WHERE NOT (role = 'system' AND r > 1) AND NOT (role = 'tool' AND trim(coalesce(text, '')) IN ('', '[]', '{}', 'null', 'None'))")
def snip_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.snip(_talk(spark, sf_dir), "conv_id", "turn", "role", "text").select("conv_id", "turn")


@register("""
WITH b AS (SELECT *, sum(CASE WHEN role = 'assistant' AND coalesce(p, '') <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS blk FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)),
m AS (SELECT *, max(CASE WHEN role = 'assistant' THEN blk END) OVER (PARTITION BY conv_id) AS last FROM b)
SELECT conv_id, turn, coalesce(role = 'assistant' AND blk <= last - 2 AND length(text) > 300, false) AS compacted FROM m""")
def microcompact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.microcompact(_talk(spark, sf_dir), "conv_id", "turn", "role", "text", kind="assistant").select("conv_id", "turn", "compacted")


@register("WITH t AS (SELECT conv_id, CAST(sum(floor(0.25 * length(coalesce(text, '')))) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id) SELECT conv_id, tokens, CASE WHEN tokens > 720 THEN 'reactive' WHEN tokens > 640 THEN 'auto' WHEN tokens > 480 THEN 'micro' WHEN tokens > 320 THEN 'leaf' ELSE 'none' END AS state FROM t")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.token_budget(_talk(spark, sf_dir), "conv_id", "text", 800)


@register("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.keep_last(_talk(spark, sf_dir), "conv_id", "turn", 6).select("conv_id", "turn")


@register("""
WITH g AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS INT) AS gain FROM events)
SELECT user_id, event_id, gain, count(*) OVER o = 5 AND sum(gain) OVER o = 0 AS saturated FROM g WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.information_gain(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@register("""
WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS st, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS run_length, len(list_filter(l, lambda x: x = event_type)) AS in_recent FROM b)
SELECT user_id, event_id, CAST(run_length AS INT) AS run_length, CAST(in_recent AS INT) AS in_recent, run_length >= 5 OR in_recent >= 5 AS is_stuck FROM c""")
def stuck_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.stuck(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@register("""
WITH a AS (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS INT) AS gain,
CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS st, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS l,
sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS empty_run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(st) OVER o AS run, count(*) OVER r = 5 AND sum(gain) OVER r = 0 AS saturated FROM a WINDOW o AS (PARTITION BY user_id ORDER BY event_id), r AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS run_length, len(list_filter(l, lambda x: x = event_type)) AS in_recent FROM b)
SELECT user_id, event_id AS step, gain, saturated, CAST(run_length AS INT) AS run_length, CAST(in_recent AS INT) AS in_recent, run_length >= 5 OR in_recent >= 5 AS is_stuck, empty_run FROM c""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state kept on a stream that runs through the table once."""
    folder = f"{checkpoint_folder(spark)}/session_stream_{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    try:
        # as a pattern, so that the table may be a file or a folder of files
        steps = session_state.steps_of_table(spark, f"{sf_dir}/events.parque[t]", e.schema, folder, files=1_000_000, session="user_id", step="event_id", tool="event_type", item="event_type", empty=F.col("value") < 20, idle_ms=366 * 86_400_000)
        return checkpointed(steps)
    finally:
        removed(spark, folder)


@register("SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM events) WHERE s = 3")
def empty_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.empty_streaks(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") < 20)


@register("""
WITH n AS (SELECT source AS kb_id, lang AS memory_type, md5('length ' || CAST(n_chars // 500 AS VARCHAR)) AS content, list_sort(list(DISTINCT CAST(doc_id AS VARCHAR))) AS s FROM documents WHERE doc_id // 20 % 2 = 1 GROUP BY ALL),
m AS (SELECT source AS kb_id, lang AS memory_type, md5('length ' || CAST(n_chars // 500 AS VARCHAR)) AS content, list_sort(list(DISTINCT CAST(doc_id AS VARCHAR))) AS s FROM documents WHERE doc_id // 20 % 2 = 0 GROUP BY ALL)
SELECT kb_id, memory_type, content, len(list_distinct(list_concat(coalesce(m.s, []), coalesce(n.s, [])))) AS sessions, CAST(CASE WHEN m.s IS NOT NULL AND n.s IS NOT NULL THEN 0.8 ELSE 0.7 END AS DOUBLE) AS score FROM m FULL JOIN n USING (kb_id, memory_type, content)""")
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kb_id"), F.col("lang").alias("memory_type"), F.md5(F.concat(F.lit("length "), F.expr("n_chars DIV 500").cast("string"))).alias("content"), F.lit(0.7).alias("score"), F.col("doc_id").cast("string").alias("session"))
    old = d.where("doc_id DIV 20 % 2 = 0").groupBy("kb_id", "memory_type", "content").agg(F.collect_set("session").alias("sessions"), F.max("score").alias("score"))  # every row is in one of the two
    out = conversation.upsert_memory(old, d.where("doc_id DIV 20 % 2 = 1"))
    return out.select("kb_id", "memory_type", "content", F.size("sessions").cast("long").alias("sessions"), F.round("score", 6).alias("score"))


@register("""
WITH h AS (SELECT doc_id, n_chars / 100000.0 AS score, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'under') AS INT) AS o FROM documents ORDER BY score DESC, doc_id LIMIT 300),
w AS (SELECT *, coalesce(count(*) OVER (ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT doc_id, CAST(round(CASE WHEN o > 0 THEN score * (1 + o * 0.2) ELSE score * 0.3 END, 9) AS DOUBLE) AS relevance FROM w WHERE o > 0 OR before < 33 ORDER BY relevance DESC, doc_id LIMIT 100""")
def memory_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 100000.0).alias("score"), F.col("text").alias("content"))
    return conversation.relevant_memories(d, "license under", "doc_id", 100)


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, sf_dir, "events"))


@register("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events),
g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(table(spark, sf_dir, "events"))


@register("SELECT role, CASE WHEN trim(text) IN ('', '[]', '{}') THEN 'transient' WHEN contains(text, '.') THEN 'critical' WHEN length(text) > 100 THEN 'normal' ELSE 'transient' END AS importance, count(*) AS n FROM conversations GROUP BY ALL")
def result_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = conversation.result_importance(F.col("text"), F.col("text").contains("."))
    return _talk(spark, sf_dir).groupBy("role", kind.alias("importance")).agg(F.count("*").alias("n"))


@register("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE text[:1400] || chr(10) || chr(10) || '[... 已截断 ' || (length(text) - 1800) || ' 字符 ...]' || chr(10) || chr(10) || right(text, 400) END AS text FROM documents")
def result_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.budgeted(F.col("text"), 2000).alias("text"))
