"""Registered queries over case notes in Chinese, which are put together from columns of orders alike here and in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import assess, conversation, entities, timeline, wiki
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


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(key: str, values: list[str]) -> str:
    """SQL that takes one of some values by a whole number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def words(key: str, values: list[str]) -> str:
    return pick(key, [quoted(v) for v in values])


# The texts: plain SQL, read by Spark and by DuckDB alike. A, B are people, C an organization, N a sum, Q an article.
PEOPLE = ["张伟", "李娜", "王芳", "陈刚", "赵敏", "刘洋", "周杰"]
ORGANIZATIONS = ["北京市公安局", "滨海市检察院", "东方贸易公司", "城西派出所"]
A, B, C = words("o_orderkey", PEOPLE), words("(o_orderkey + 3)", PEOPLE), words("o_custkey", ORGANIZATIONS)
N = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
Q = "CAST(200 + o_custkey % 100 AS STRING)"
BODIES = [
    f"concat({A}, '向', {B}, '转账，金额', {N}, '元，资金用途不明。')",
    f"concat({A}, '担任', {C}, '经理，', {B}, '为股东。')",
    f"concat({A}, '与', {B}, '系夫妻，育有子女。')",
    f"concat({A}, '与', {B}, '通话，电话联系多次。')",
    f"concat({A}, '与', {B}, '签署合同，甲方为', {C}, '，另签协议。')",
    f"concat({C}, '对', {A}, '依法进行询问，犯罪嫌疑人讯问笔录在卷。')",
    f"concat({A}, '伙同', {B}, '共谋骗取被害人', {N}, '元，5天后案发。')",
    f"concat('依据《刑法》第', {Q}, '条，本院认为判决如下：', {A}, '共计退赔', {N}, '元，涉及12笔。')",
    f"concat({A}, '见', {B}, '，另查刑法第', {Q}, '条。')",
]
DATE = "concat(CAST(year(o_orderdate) AS STRING), '年', CAST(month(o_orderdate) AS STRING), '月', CAST(day(o_orderdate) AS STRING), '日')"
NOTE = f"concat({DATE}, '，', {pick('o_orderkey', BODIES)})"
NOTES = f"notes AS (SELECT o_orderkey, o_custkey, o_orderdate, floor(o_totalprice) AS amount, {NOTE} AS note FROM orders)"
DAY, MONTH = "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%Y-%m')"

QUESTIONS = ["他们的关系是什么", "统计每个人的金额", "他是谁", "两份笔录有什么矛盾", "2023年5月到2024年发生了什么", "证据链是否充分", "案件经过", "你好", "Excel里的表格", "为什么3月5日见面"]
QUESTION = words("o_orderkey", QUESTIONS)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey, o_orderdate, note."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.expr(NOTE).alias("note"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(QUESTION).alias("question"))


def any_of(text: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(v)})" for v in values) + ")"


def count_of(text: str, values: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {quoted(v)}) AS INT)" for v in values) + ")"


# ---- dates and events


@register(f"WITH {NOTES} SELECT o_orderkey, {DAY} || ',' || {DAY} || ',' || {MONTH} AS dates FROM notes")
def note_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("o_orderkey", F.array_join(T.merge_dates(F.col("note")), ",").alias("dates"))


@register(f"WITH {NOTES} SELECT o_orderkey, 0 AS start, d AS date FROM (SELECT o_orderkey, unnest([{DAY}, {DAY}, {MONTH}]) AS d FROM notes)")
def note_dates_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = notes(spark, sf_dir).select("o_orderkey", F.explode(T.timeline_dates(F.col("note"))).alias("d"))
    return d.select("o_orderkey", "d.start", "d.date")


def title_sql(text: str) -> str:
    tried = [f"CASE WHEN length(trim(regexp_extract({text}, {quoted(p)}, 1))) BETWEEN 5 AND 50 THEN trim(regexp_extract({text}, {quoted(p)}, 1)) END".replace("\\n", "\n") for p in T.TITLE_PATTERNS]
    return f"coalesce({', '.join(tried)}, CASE WHEN length({text}) <= 50 THEN {text} ELSE {text}[:50] || '...' END)"


@register(f"WITH {NOTES} SELECT o_orderkey, {title_sql('note')} AS title FROM notes")
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth text has a stored chunk's header."""
    header = F.when(F.col("o_orderkey") % 4 == 0, "**Is Overlap:** no\n---\n").otherwise("")
    return notes(spark, sf_dir).select("o_orderkey", timeline.event_title(F.concat(header, "note")).alias("title"))


RELATIVE = ["3天后", "2个月前", "1年后", "次日", "当天", "没有日期"]


@register(f"""WITH e AS (SELECT user_id, event_id, {words('event_id', RELATIVE)} AS text, CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') END AS date FROM events),
l AS (SELECT *, lag(date, 1) OVER w AS a, lag(date, 2) OVER w AS b, lag(date, 3) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT *, CAST(coalesce(a, b, c) AS DATE) AS base FROM l)
SELECT user_id, event_id, coalesce(date, strftime({pick('event_id', ['base + 3', 'base - 60', 'base + 365', 'base + 1', 'base', 'NULL::DATE'])}, '%Y-%m-%d')) AS resolved FROM m""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.expr(words("event_id", RELATIVE)).alias("text"))
    return timeline.resolve_relative(e, "user_id", "event_id", "date", "text").select("user_id", "event_id", "resolved")


@register("SELECT user_id, event_id FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE value < p")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose value, standing for a date, is less than the one before."""
    return timeline.out_of_order(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id")


PLACES = ", ".join(f"({i}, {quoted(n)})" for i, n in enumerate(PEOPLE + ORGANIZATIONS))


@register(f"""WITH {NOTES}, people(id, name) AS (VALUES {PLACES}),
f AS (SELECT 'k' || o_custkey % 3 AS kb_id, o_orderkey, note, unnest([{DAY}, {MONTH}]) AS date, unnest([0, 2]) AS place FROM notes),
d AS (SELECT kb_id, date, note, arg_min(o_orderkey, (o_orderkey, place)) AS o_orderkey, min((o_orderkey, place)) AS seq FROM f GROUP BY kb_id, date, note[:60], note),
w AS (SELECT d.*, (SELECT list(p.name ORDER BY CAST(p.id AS VARCHAR)) FROM people p WHERE contains(d.note, p.name))[:5] AS participants FROM d),
l AS (SELECT *, [lag(date, 3) OVER o, lag(date, 2) OVER o, lag(date, 1) OVER o] AS b, row_number() OVER o AS n FROM w WINDOW o AS (PARTITION BY kb_id ORDER BY date, seq)),
r AS (SELECT *, list_filter(b, lambda x: length(x) = 10)[1] AS base FROM l),
m AS (SELECT kb_id, note, participants, o_orderkey, n, CASE WHEN contains(note, '5天后') THEN base END AS inferred_from,
             CASE WHEN contains(note, '5天后') AND base IS NOT NULL THEN strftime(CAST(base AS DATE) + 5, '%Y-%m-%d') ELSE date END AS date,
             CASE WHEN contains(note, '5天后') AND base IS NOT NULL THEN 0.5 ELSE 0.6 END AS confidence FROM r)
SELECT kb_id, date, {title_sql('arg_min(note, n)')} AS title, arg_min(note, n) AS description, array_to_string(flatten(list(participants ORDER BY n)), ',') AS participants,
       string_agg(o_orderkey, ',' ORDER BY n) AS source_docs, CAST(max(confidence) AS DOUBLE) AS confidence, coalesce(arg_min(coalesce(inferred_from, ''), n), '') AS inferred_from
FROM m GROUP BY kb_id, date, note[:50]""")
def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    chunks = n.select(F.concat(F.lit("k"), (F.col("o_custkey") % 3).cast("string")).alias("kb_id"), F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderkey").alias("seq"), F.col("note").alias("text"))
    people = spark.createDataFrame([(f"k{k}", i, name) for k in range(3) for i, name in enumerate(PEOPLE + ORGANIZATIONS)], "kb_id string, id int, name string")
    none = spark.createDataFrame([], "kb_id string, seq long, summary string, chunk_ids array<string>, names array<string>")
    d = timeline.build(chunks, people, none)
    return d.select("kb_id", "date", "title", "description", F.array_join("participants", ",").alias("participants"), F.array_join("source_docs", ",").alias("source_docs"), "confidence", F.coalesce("inferred_from", F.lit("")).alias("inferred_from"))


@register(f"""WITH {NOTES}, s AS (SELECT o_orderkey, note, {DAY} AS day, {MONTH} AS month, {A} AS a, {B} AS b FROM notes WHERE o_orderkey % 9 = 2)
SELECT date, '{{}}' AS source_docs, note AS description, list_sort([a, b])[1] || ',' || list_sort([a, b])[2] AS participants, CAST(0.8 AS DOUBLE) AS confidence
FROM (SELECT note, a, b, unnest([day, month]) AS date FROM s) GROUP BY ALL""".replace("'{}'", "''"))
def summary_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 2").select(F.lit("k").alias("kb_id"), F.col("o_orderkey").alias("seq"), F.expr(NOTE).alias("summary"), F.array(F.col("o_orderkey").cast("string")).alias("chunk_ids"), F.array(F.expr(A), F.expr(B)).alias("names"))
    people = spark.createDataFrame([("k", name, name) for name in PEOPLE], "kb_id string, id string, name string")
    none = spark.createDataFrame([], "kb_id string, doc_id string, chunk_id string, seq long, text string")
    return timeline.build(none, people, n).select("date", F.array_join("source_docs", ",").alias("source_docs"), "description", F.array_join("participants", ",").alias("participants"), "confidence")


# ---- kinds of text


def best_relation(text: str) -> str:
    """The type and score of the best relation, as SQL: the best score, among equals the first type."""
    options = [f"CASE WHEN {count_of(text, w)} >= 2 THEN least(1.0, round({base} + 0.05 * {count_of(text, w)}, 10)) ELSE 0.0 END" for _, w, base in T.RELATION_TYPES]
    names = ", ".join(quoted(k) for k, *_ in T.RELATION_TYPES)
    return f"[{', '.join(options)}] AS s, [{names}] AS k"


@register(f"""WITH {NOTES}, r AS (SELECT o_orderkey, {A} AS subject, '涉及' AS predicate, {B} AS object, note, {best_relation(f"({A} || ' 涉及 ' || {B} || ' ' || note)")} FROM notes),
b AS (SELECT *, list_max(s) AS m FROM r), t AS (SELECT *, CASE WHEN m > 0.5 THEN k[list_position(s, m)] ELSE '相关' END AS kind, greatest(m, 0.5) AS score FROM b),
f AS (SELECT *, kind <> '资金往来' AND score < 0.7 AND regexp_matches(note, {quoted(T.MONEY)}) AS money FROM t)
SELECT o_orderkey, subject, object, CASE WHEN money THEN '资金往来' ELSE kind END AS type, CAST(CASE WHEN money THEN 0.7 ELSE score END AS DOUBLE) AS weight FROM f""")
def typed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(A).alias("subject"), F.lit("涉及").alias("predicate"), F.expr(B).alias("object"), F.expr(NOTE).alias("summary"))
    return entities.typed_relations(r).select("o_orderkey", "subject", "object", "type", "weight")


@register(f"WITH {NOTES} SELECT CASE {' '.join(f'WHEN {count_of("note", w)} >= 2 THEN {quoted(k)}' for k, w in T.DOCUMENT_TYPES)} ELSE '其他' END AS doc_type, count(*) AS n FROM notes GROUP BY 1")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).groupBy(T.document_type(F.col("note")).alias("doc_type")).agg(F.count("*").alias("n"))


@register(f"WITH {NOTES} SELECT o_orderkey, CASE o_orderkey % 9 WHEN 7 THEN '刑法' || (200 + o_custkey % 100) WHEN 8 THEN CAST(200 + o_custkey % 100 AS VARCHAR) ELSE '' END AS refs FROM notes")
def legal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("o_orderkey", F.array_join(T.legal_references(F.col("note")), ",").alias("refs"))


@register(f"""WITH {NOTES}, v AS (SELECT o_orderkey, note, unnest(list_concat(regexp_extract_all(note, {quoted(T.KEY_NUMBERS[0])}), regexp_extract_all(note, {quoted(T.KEY_NUMBERS[1])}), regexp_extract_all(note, {quoted(T.KEY_NUMBERS[2])}))) AS value FROM notes),
p AS (SELECT *, strpos(note, value) - 1 AS s FROM v)
SELECT o_orderkey, value, trim(substr(note, greatest(0, s - 30) + 1, s + length(value) + 30 - greatest(0, s - 30))) AS context FROM p""")
def key_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = notes(spark, sf_dir).select("o_orderkey", F.explode(T.key_numbers(F.col("note"))).alias("x"))
    return d.select("o_orderkey", "x.value", "x.context")


# ---- names


@register(f"""WITH {NOTES}, c AS (SELECT DISTINCT o_orderkey, unnest(regexp_extract_all(note, '[一-鿿]{{2,6}}')) AS name FROM notes)
SELECT o_orderkey, name FROM c WHERE name NOT IN ({', '.join(map(quoted, T.CANDIDATE_STOPWORDS))}) AND NOT regexp_matches(name, '^[{T.GRAMMAR_PARTICLES}]')""")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("o_orderkey", F.explode(T.entity_candidates(F.col("note"))).alias("name"))


SPELLINGS = [" 张　伟  ", "Session_ValidateToken!", "北京市公安局", "中山路12号", "张伟", "A (b) C", "", "东方 贸易", "河北省石家庄市长安区"]
KINDS = ["嫌疑人", "org", "ORG", "地点", "unknown", "", "Gadget", "文件", "people"]
STANDARD = ["person", "organization", "org", "location", "unknown", "unknown", "gadget", "document", "person"]


@register(f"""WITH s AS (SELECT p_partkey, {words('p_partkey', SPELLINGS)} AS spelling FROM part)
SELECT p_partkey, {words('p_partkey', ["张 伟", "Session_ValidateToken!", "北京市公安局", "中山路12号", "张伟", "A (b) C", "", "东方 贸易", "河北省石家庄市长安区"])} AS name,
       regexp_replace(regexp_replace(lower(regexp_replace(spelling, '[^a-zA-Z0-9一-鿿]+', '_', 'g')), '^_+', ''), '_+$', '') AS id,
       replace(replace(replace(lower(trim(spelling)), ' ', ''), '(', ''), ')', '') AS norm,
       {words('p_partkey', ["unknown", "unknown", "organization", "location", "person", "unknown", "unknown", "unknown", "location"])} AS kind_by_name,
       {words('p_partkey', STANDARD)} AS kind,
       {words('p_partkey', ["张-伟", "session-validatetoken", "北京市公安局", "中山路12号", "张伟", "a-b-c", "", "东方-贸易", "河北省石家庄市长安区"])} AS slug FROM s""")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, raw = F.expr(words("p_partkey", SPELLINGS)), F.expr(words("p_partkey", KINDS))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise_name(s).alias("name"), T.normalise_id(s).alias("id"), T.normalise_value(s).alias("norm"), T.entity_type_from_name(s).alias("kind_by_name"), T.entity_type(raw).alias("kind"), wiki.slug(s).alias("slug"))


GRAPH_QUESTIONS = ['查询"张伟"的关系', "公司东方贸易的情况", "李娜的关系", "find Anna Berg", "张伟和李娜的关系", "北京到上海", "12 34"]
GRAPH_NAMES = ["张伟", "东方贸易的情况", "李娜", "find", "张伟和李娜", "北京到上海", "12 34"]
GRAPH_PAIRS = ["查询,张伟", "公司东方贸易的情况", "李娜的关系", "find,Anna", "张伟,李娜的关系", "北京,上海", ""]


@register(f"SELECT p_partkey, {words('p_partkey', GRAPH_NAMES)} AS name, {words('p_partkey', GRAPH_PAIRS)} AS pair FROM part")
def graph_question_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr(words("p_partkey", GRAPH_QUESTIONS))
    return table(spark, sf_dir, "part").select("p_partkey", T.graph_name(q).alias("name"), F.array_join(T.graph_pair(q), ",").alias("pair"))


ABSTRACTS = ["摘要\n关键实体：张伟，李娜、 某公司 ；无", "关键实体: Anna, Bo, C", "没有这一行", "关键实体：暂无"]


@register(f"SELECT p_partkey, {words('p_partkey', ['张伟|李娜|某公司', 'Anna|Bo', '', ''])} AS names FROM part")
def abstract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.abstract_entities(F.expr(words("p_partkey", ABSTRACTS).replace("\\", "\\\\"))), "|").alias("names"))


# ---- questions


@register(f"""WITH q AS (SELECT o_orderkey, {QUESTION} AS q FROM orders)
SELECT o_orderkey, CASE WHEN {any_of('q', T.TABLE_TOTALS)} OR {any_of('q', T.COMPLEX_WORDS)} THEN 'complex' WHEN {any_of('q', T.MEDIUM_WORDS)} THEN 'medium' WHEN {any_of('q', T.SIMPLE_WORDS)} THEN 'simple' ELSE 'medium' END AS complexity FROM q""")
def question_complexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("o_orderkey", T.question_complexity(F.col("question")).alias("complexity"))


@register(f"""WITH q AS (SELECT o_orderkey, {QUESTION} AS q FROM orders),
t AS (SELECT *, CASE WHEN {any_of('q', T.TABLE_WORDS + T.TOTAL_WORDS)} THEN 'tabular' {' '.join(f'WHEN {any_of("q", w)} THEN {quoted(k)}' for k, w in T.QUESTION_TYPES)} ELSE 'factual' END AS kind FROM q),
c AS (SELECT *, CASE WHEN kind = 'tabular' THEN CASE WHEN {any_of('q', T.TOTAL_WORDS)} THEN 'complex' ELSE 'medium' END WHEN {any_of('q', T.INTENT_COMPLEX)} OR kind IN ('analytical', 'comparative') THEN 'complex' WHEN {any_of('q', T.INTENT_MEDIUM)} OR kind = 'relational' THEN 'medium' ELSE 'simple' END AS complexity FROM t),
x AS (SELECT *, regexp_extract_all(q, {quoted(T.TIME_EXPRESSION)}) AS found FROM c)
SELECT o_orderkey, kind, complexity, CASE WHEN kind = 'tabular' THEN 'L1' WHEN complexity = 'simple' THEN 'L0' WHEN kind = 'evidential' THEN 'L2' ELSE 'L1' END AS level,
       coalesce(found[1], '') AS first, CASE WHEN len(found) > 1 THEN found[-1] ELSE '' END AS last FROM x""")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("kind", T.question_type(F.col("question")))
    q = q.withColumn("complexity", T.intent_complexity(F.col("question"), F.col("kind"))).withColumn("range", T.question_time_range(F.col("question")))
    return q.select("o_orderkey", "kind", "complexity", T.start_level(F.col("kind"), F.col("complexity")).alias("level"), F.coalesce("range.first", F.lit("")).alias("first"), F.coalesce("range.last", F.lit("")).alias("last"))


@register()
def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sub-queries of questions; a test compares them with a plain loop."""
    q = questions(spark, sf_dir).withColumn("question", F.concat(F.expr(words("o_orderkey", PEOPLE)), F.lit("和李娜"), "question"))
    q = q.withColumn("kind", T.question_type(F.col("question"))).withColumn("names", T.question_names(F.col("question")))
    q = q.withColumn("complexity", T.intent_complexity(F.col("question"), F.col("kind")))
    d = q.select("o_orderkey", "question", "names", F.posexplode(T.sub_queries(F.col("question"), F.col("names"), F.col("kind"), F.col("complexity"))).alias("place", "s"))
    return d.select("o_orderkey", "question", F.array_join("names", ",").alias("names"), "place", "s.query", "s.layer", "s.search", "s.priority")


def grams(text: str, n: int) -> str:
    return f"list_transform(range(CAST(floor(length({text}) / {n}) AS BIGINT)), lambda i: substr({text}, i * {n} + 1, {n}))"


@register(f"""WITH q AS (SELECT o_orderkey, regexp_replace(c, '[{T.SEARCH_PARTICLES}]', '', 'g') AS t, c FROM (SELECT o_orderkey, {QUESTION} AS c FROM orders)),
g AS (SELECT o_orderkey, list_filter(CASE WHEN regexp_matches(c, '^[一-鿿]+$') THEN list_concat({grams('t', 4)}, {grams('t', 3)}, {grams('t', 2)}) ELSE [c] END, lambda x: x NOT IN ({', '.join(map(quoted, T.SEARCH_STOPWORDS))})) AS l FROM q)
SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:8], ' ') AS words FROM g""")
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("o_orderkey", F.array_join(T.ngram_words(F.col("question")), " ").alias("words"))


# ---- answers of models


ANSWERS = ['so: ```json\n{"a": 1}\n``` ok', 'x {"a": {"b": "}"}} y {"c": 2}', "none", '{"open": 1', '```[1, 2]```', '{"q": "say \\\\"hi\\\\" {"} rest']
OBJECTS = ['{"a": 1}', '{"a": {"b": "}"}}', "", "", "[1, 2]", '{"q": "say \\\\"hi\\\\" {"}']


def both_ways(values: list[str]) -> str:
    """Spark reads a backslash in a literal as an escape; DuckDB does not."""
    return words("p_partkey", values)


@register(f"SELECT p_partkey, {words('p_partkey', [o.replace(chr(92) * 2, chr(92)) for o in OBJECTS])} AS json FROM part")
def answer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(T.json_object(F.expr(both_ways(ANSWERS))), F.lit("")).alias("json"))


SCORES = ['[{"score": 3}, {"x": 1}]', "so: [1, 2.5]", "none", "[]"]


@register(f"SELECT p_partkey, {words('p_partkey', ['3.0,5.0', '1.0,2.5', '', ''])} AS scores FROM part")
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = assess.rerank_scores(F.expr(words("p_partkey", SCORES)))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.array_join(s.cast("array<string>"), ","), F.lit("")).alias("scores"))


RESULTS = ['{"name": "Anna", "role": "lead", "doc_id": "d1"}', '[{"entities": ["Bo Li", "X"], "type": "t"}, {"person_name": "Cy", "source": "s2"}]', "张伟与李娜见面", "{}", '[{"note": "nothing"}]', "plain words only"]


@register(f"""SELECT p_partkey, {words('p_partkey', ['Anna', 'Bo Li,Cy', '张伟与李娜见', '', '', ''])} AS names, {words('p_partkey', ['lead', 't', '', '', '', ''])} AS relations,
{words('p_partkey', ['d1', 's2', '', '', '', ''])} AS docs, {words('p_partkey', ['critical', 'critical', 'critical', 'transient', 'transient', 'transient'])} AS importance FROM part""")
def result_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.expr(words("p_partkey", RESULTS))
    joined = lambda c: F.array_join(c, ",")
    return table(spark, sf_dir, "part").select("p_partkey", joined(T.json_names(r)).alias("names"), joined(T.json_values(r, T.RELATION_KEYS)).alias("relations"), joined(T.json_values(r, T.DOCUMENT_KEYS)).alias("docs"), conversation.classified_result(r).alias("importance"))


TITLES = ["证据清单", "案发经过", "嫌疑人张伟", "A Model", "Other"]


@register(f"SELECT p_partkey, {words('p_partkey', ['evidence', 'event', 'person', 'default', 'default'])} AS plain, {words('p_partkey', ['evidence', 'event', 'person', 'method', 'default'])} AS technical FROM part")
def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr(words("p_partkey", TITLES))
    return table(spark, sf_dir, "part").select("p_partkey", assess.template_type(t, F.lit(None)).alias("plain"), assess.template_type(t, F.lit(""), True).alias("technical"))


@register("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no_results' WHEN value / 100 < 0.3 THEN 'low_relevance' ELSE 'clear' END AS state, event_id % 3 = 0 AND (value / 100 >= 0.8 OR (value / 100 >= 0.6 AND event_id % 2 = 0) OR event_type = 'error') AS stop FROM events")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    score, n = F.col("value") / 100, F.col("event_id")
    stop = conversation.converged(score, n % 2, F.when(F.col("event_type") != "error", "next"), n)
    return e.select("event_id", assess.interaction_state(score, n % 4).alias("state"), stop.alias("stop"))


@register("SELECT event_id, event_id % 4 > 0 AND event_id % 3 = 0 AS verified, CAST(CASE WHEN event_id % 4 > 0 AND event_id % 3 = 0 THEN least(0.95, 0.6 + 0.1 * (event_id % 4)) WHEN event_id % 4 > 0 THEN 0.3 ELSE 0.1 END AS DOUBLE) AS confidence, CASE WHEN event_id % 2 = 0 THEN 'first item ' || event_id || '|second one' ELSE '' END AS items FROM events")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    v = conversation.verdict(n % 4, n % 3)
    answer = F.when(n % 2 == 0, F.concat(F.lit("Findings:\n1. first item "), n.cast("string"), F.lit("\n- second one\n* few\n"))).otherwise("nothing to list")
    return table(spark, sf_dir, "events").select("event_id", v["verified"].alias("verified"), F.round(v["confidence"], 9).alias("confidence"), F.array_join(conversation.evidence_items(answer), "|").alias("items"))
