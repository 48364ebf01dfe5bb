"""Registered queries over sheets: columns of every kind, questions about them, reports, banners and tables in Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import assess, tabular
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


#: A sheet with a column of each kind: text, as a sheet is read.
COLUMNS = ["id", "flag", "rate", "day", "empty", "name"]
SHEET = """sheet AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN '是' ELSE '否' END AS flag, CAST(o_totalprice AS VARCHAR) AS rate,
CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y年%m月%d日') ELSE 'unknown' END AS day, CAST(NULL AS VARCHAR) AS empty, o_orderpriority AS name, o_orderdate FROM orders)"""


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    day = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, F.date_format("o_orderdate", "yyyy年MM月dd日")).otherwise("unknown")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "是").otherwise("否").alias("flag"), F.col("o_totalprice").cast("string").alias("rate"), day.alias("day"), F.lit(None).cast("string").alias("empty"), F.col("o_orderpriority").alias("name"))


KINDS = """kinds AS (SELECT * FROM (VALUES ('id', 'integer'), ('flag', 'boolean'), ('rate', 'float'), ('day', 'date'), ('empty', 'empty'), ('name', 'string')) AS t("column", data_type))"""
FACTS = f"""{SHEET}, {KINDS}, cl AS (SELECT unnest(['id', 'flag', 'rate', 'day', 'empty', 'name']) AS "column", unnest([id, flag, rate, day, empty, name]) AS value FROM sheet),
facts AS (SELECT "column", count(*) AS n_rows, count(*) FILTER (coalesce(value, '') = '') AS null_count, count(DISTINCT value) FILTER (value <> '') AS unique_count, list_sort(list(DISTINCT value) FILTER (value <> ''))[1:5] AS samples FROM cl GROUP BY 1)"""


@register(f'WITH {FACTS} SELECT "column", n_rows, null_count, unique_count, data_type, CASE WHEN "column" = \'rate\' THEN 5 ELSE len(coalesce(samples, [])) END AS n_samples, CASE WHEN "column" IN (\'rate\', \'day\') THEN \'\' ELSE coalesce(array_to_string(samples, \'|\'), \'\') END AS samples FROM facts JOIN kinds USING ("column")')
def sheet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tabular.described(_sheet(spark, sf_dir), COLUMNS)
    # the two engines write doubles and sort beyond ASCII in their own ways
    text = F.when(F.col("column").isin("rate", "day"), "").otherwise(F.array_join("samples", "|"))
    return d.select("column", "n_rows", "null_count", "unique_count", "data_type", F.size("samples").alias("n_samples"), text.alias("samples"))


@register(f"WITH {SHEET} SELECT 'day' AS \"column\", strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM sheet WHERE day <> 'unknown'")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.date_distribution(_sheet(spark, sf_dir), ["day", "name"])


@register("SELECT count(DISTINCT p_brand) AS n_groups FROM part WHERE p_size = 7")
def distinct_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.distinct_groups(table(spark, sf_dir, "part"), "p_brand", F.col("p_size") == 7)


@register("SELECT p_size AS value, count(*) AS n FROM part WHERE p_type = (SELECT min(p_type) FROM part) GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def sheet_filter_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that the question names becomes the filter."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.col("p_type").alias("kind"))
    first = p.agg(F.min("kind")).first()[0]
    return tabular.table_question(p, f"count of each size where kind is {first}", ["size", "kind"])


@register("SELECT 1 AS position, 'Team' AS \"column\", 'integer' AS data_type, count(DISTINCT n_regionkey) AS unique_count, 0 AS null_count, '0|1|2' AS samples FROM nation")
def sheet_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word for a country stands for a column of another name."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("Team"), F.col("n_nationkey").alias("id"))
    return tabular.describe_question(n, "国家情况", ["Team", "id"]).withColumn("samples", F.array_join("samples", "|"))


@register("""WITH s AS (SELECT count(*) AS n, count(DISTINCT r_regionkey) AS u FROM region), lines AS (
SELECT 1 AS n, '## Sheet: regions (' || n || '行 x 2列)' AS line FROM s UNION ALL SELECT 2, '### 列结构' UNION ALL SELECT 3, '| 列名 | 类型 | 空值 | 唯一值 | 样本值 |' UNION ALL SELECT 4, '|---|---|---|---|---|'
UNION ALL SELECT 5, '| r_regionkey | integer | 0 | ' || u || ' | 0, 1, 2 |' FROM s UNION ALL SELECT 6, '| r_name | string | 0 | ' || u || ' | ' || (SELECT array_to_string(list_sort(list(r_name))[1:3], ', ') FROM region) || ' |' FROM s
UNION ALL SELECT 7, '### 关键分布' UNION ALL SELECT 8, '- **r_regionkey**: 均值=' || printf('%.2f', avg(r_regionkey)) || ', 中位数=' || printf('%.2f', median(r_regionkey)) || ', 标准差=' || printf('%.2f', stddev_samp(r_regionkey)) || ', 范围=[' || printf('%.2f', min(r_regionkey)::DOUBLE) || ', ' || printf('%.2f', max(r_regionkey)::DOUBLE) || ']' FROM region
UNION ALL SELECT 9, '- **r_name**: ' || string_agg(r_name || '(1)', ', ' ORDER BY r_name) FROM region UNION ALL SELECT 10, '### 数据发现') SELECT n, line FROM lines""")
def sheet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.analysis_report(table(spark, sf_dir, "region"), ["r_regionkey", "r_name"], "regions")


@register("SELECT c_nationkey AS key, n_name AS \"nation_name\", count(*) AS n, round(sum(c_acctbal), 2) AS total, count(*) FILTER (c_acctbal < 0) AS below FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 > 0 GROUP BY ALL")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a Markdown table for each nation, read back as typed columns and counted; every tenth row is blank."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are few
    row = F.when(F.col("c_custkey") % 10 == 0, "|  |  | |").otherwise(F.concat(F.lit("| "), F.col("c_custkey").cast("string"), F.lit(" | "), "n_name", F.lit(" | "), F.format_string("%.2f", "c_acctbal"), F.lit(" |")))
    texts = c.groupBy(F.col("c_nationkey").alias("key")).agg(F.concat(F.lit("intro\n| 1st id | nation name | balance |\n|---|---|---|\n"), F.array_join(F.sort_array(F.collect_list(row)), "\n")).alias("text"))
    d = tabular.sheet_table(tabular.markdown_rows(texts, "key", "text"), "key")
    return d.groupBy("key", "nation_name").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("total"), F.count_if(F.col("balance") < 0).alias("below"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE printf('%d', p_size) || '.25' END AS cell, CAST(DATE '1899-12-30' + CAST(p_partkey AS INT) AS VARCHAR) AS day FROM part")
def cell_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 7 == 0, None).when(k % 3 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") + 0.25)
    return table(spark, sf_dir, "part").select("p_partkey", tabular.formatted_cell(value).alias("cell"), tabular.excel_date(k).cast("string").alias("day"))


@register("SELECT n_regionkey AS sheet, 0 AS row, 'Title ' || n_regionkey AS text FROM nation WHERE n_regionkey % 2 = 0 GROUP BY n_regionkey")
def sheet_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of even regions have a title over all columns; the others repeat it without a merged range."""
    n = table(spark, sf_dir, "nation")
    sheets = n.select(F.col("n_regionkey").alias("sheet")).distinct()
    title = sheets.select("sheet", F.lit(0).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col"), F.concat(F.lit("Title "), F.col("sheet").cast("string")).alias("value"))
    body = n.select(F.col("n_regionkey").alias("sheet"), (F.col("n_nationkey") % 3 + 1).alias("row"), (F.col("n_nationkey") % 5).alias("col"), F.col("n_name").alias("value"))
    merges = sheets.where("sheet % 2 = 0").select("sheet", F.lit(0).alias("row"), F.lit(5).alias("col_span"))
    return assess.banner_rows(title.unionByName(body), merges)


BUYERS = "p AS (SELECT c_mktsegment AS segment, c_nationkey AS nation FROM customer)"


@register(f"""WITH {BUYERS}, listed AS (SELECT * FROM (VALUES ('count', 1, 'segment', 'string'), ('count', 2, 'nation', 'integer'), ('show', 1, 'nation', 'integer'), ('sample', 1, 'segment', 'string'), ('sample', 2, 'nation', 'integer')) AS t(question, position, "column", value)),
u AS (SELECT 'segment' AS "column", count(DISTINCT segment) AS n FROM p UNION ALL SELECT 'nation', count(DISTINCT nation) FROM p),
top AS (SELECT segment AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, segment) AS position FROM p GROUP BY 1 QUALIFY position <= 5),
g AS (SELECT nation, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, nation) AS position FROM p WHERE segment = 'BUILDING' GROUP BY 1 QUALIFY position <= 15),
s AS (SELECT segment, nation, row_number() OVER (ORDER BY segment, nation) AS n FROM p QUALIFY n <= 5)
SELECT question, 'column' AS section, CAST(position AS INT) AS position, "column", value, n FROM listed JOIN u USING ("column")
UNION ALL SELECT q, 'top', CAST(position AS INT), 'segment', value, n FROM top, (VALUES ('count'), ('sample')) AS t(q)
UNION ALL SELECT 'count', 'group', CAST(row_number() OVER (ORDER BY n DESC, CAST(nation AS VARCHAR)) AS INT), 'nation', CAST(nation AS VARCHAR), n FROM g
UNION ALL SELECT 'sample', 'sample', 1, 'segment', segment, n FROM s UNION ALL SELECT 'sample', 'sample', 2, 'nation', CAST(nation AS VARCHAR), n FROM s""")
def sheet_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions about customers: one asks for counts where a value is named, one shows a column, one asks for samples."""
    p = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    asked = [("count", "count the nation where segment = BUILDING", "describe"), ("show", "show nation", "describe"), ("sample", "segment, nation", "sample")]
    found = [tabular.search_sheet(p, question, ["segment", "nation"], how).withColumn("question", F.lit(name)) for name, question, how in asked]
    return found[0].unionByName(found[1]).unionByName(found[2])
