"""Profiling of tables whose cells are text, and grouped counts over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.quantiles import exact_quantiles

# ---- fixed values: words that make a boolean column, formats of a date column, words that ask for counts, and what
# column names may stand for words of a question
BOOLEANS = ["true", "false", "是", "否", "对", "错", "1", "0"]
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy年MM月dd日", "yyyy-MM-dd HH:mm:ss"]
COUNT_WORDS = ["统计", "计数", "分组", "汇总", "求和", "平均", "排名", "count", "group", "sum", "avg", "多少", "几个", "每种", "各个", "分别", "分布", "数量", "占比", "最多", "最少", "top", "排行", "排序", "降序", "升序"]
COLUMN_WORDS = {
    "国家": ["Team", "NOC", "Country", "Nation", "team", "noc", "country"],
    "队伍": ["Team", "NOC", "team", "noc"],
    "金牌": ["Medal", "Gold", "medal", "gold"],
    "奖牌": ["Medal", "medal"],
    "银牌": ["Silver", "silver"],
    "铜牌": ["Bronze", "bronze"],
    "姓名": ["Name", "name"],
    "名字": ["Name", "name"],
    "年龄": ["Age", "age"],
    "身高": ["Height", "height"],
    "体重": ["Weight", "weight"],
    "年份": ["Year", "year"],
    "季节": ["Season", "season"],
    "城市": ["City", "city"],
    "运动": ["Sport", "sport"],
    "项目": ["Event", "event"],
    "性别": ["Sex", "sex"],
    "比赛": ["Games", "Event", "games", "event"],
    "参赛": ["Games", "Event", "games", "event"],
}
# ----


def cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): all cells, null as empty, in one pass for all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("value")) for c in columns]))
    return rows.select(pairs.alias("c")).select("c.column", "c.value")


def number(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def date(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS])


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: n_rows, null_count (blank), unique_count (exact), data_type.

    boolean if over 80 % of the filled cells are boolean words, else integer or float if over 80 % are numbers (float
    with any point), else date if over half are dates, else string; empty without a filled cell. One grouping by value
    comes first, so that repeated values of a column, however many, are counted on the map side.
    """
    counts = cells(rows, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    filled = F.col("value") != ""
    v = F.col("value")
    of = lambda c: F.sum(F.when(filled & c, F.col("n")).otherwise(0))
    d = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("null_count"),
        F.count_if(filled).alias("unique_count"),
        of(F.lower(v).isin(BOOLEANS)).alias("b"),
        of(number(v).isNotNull()).alias("x"),
        of(date(v).isNotNull()).alias("d"),
        F.max(F.when(number(v).isNotNull() & v.contains("."), 1).otherwise(0)).alias("point"),
    )
    n = F.col("n_rows") - F.col("null_count")
    kind = F.when(n == 0, "empty").when(F.col("b") > 0.8 * n, "boolean").when((F.col("x") > 0.8 * n) & (F.col("point") == 1), "float").when(F.col("x") > 0.8 * n, "integer").when(F.col("d") > 0.5 * n, "date").otherwise("string")
    return d.select("column", "n_rows", "null_count", "unique_count", kind.alias("data_type"))


def numeric_distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, exact median, sample deviation (0 for a single value), least and greatest of each column's numbers, two places."""
    d = cells(rows, columns).select("column", number(F.col("value")).alias("x")).where("x IS NOT NULL")
    r = lambda c, name: F.round(c, 2).alias(name)
    rest = d.groupBy("column").agg(r(F.avg("x"), "mean"), r(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), "std"), r(F.min("x"), "min"), r(F.max("x"), "max"))
    medians = exact_quantiles(d, "column", "x", [0.5]).select("column", r(F.col("value"), "median"))
    return rest.join(F.broadcast(medians), "column").select("column", "mean", "median", "std", "min", "max")


def string_distribution(rows: DataFrame, columns: list[str], top: int = 15) -> DataFrame:
    """(column, value, n, pct, position): the commonest filled values with their share in percent, one place."""
    counts = cells(rows, columns).where("value != ''").groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("position", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("position") <= top)
    return ranked.join(F.broadcast(totals), "column").select("column", "value", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"), "position")


def date_distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    d = cells(rows, columns).select("column", F.date_format(date(F.col("value")), "yyyy-MM-dd").alias("d")).where("d IS NOT NULL")
    return d.groupBy("column").agg(F.min("d").alias("earliest"), F.max("d").alias("latest"))


def findings(profiles: DataFrame) -> DataFrame:
    """(column, finding): constant, high_null and high_cardinality columns of a profile."""
    n, nulls, unique = F.col("n_rows"), F.col("null_count"), F.col("unique_count")
    found = F.array_compact(F.array(F.when((unique == 1) & (n > 5), "constant"), F.when(nulls > 0.5 * n, "high_null"), F.when((unique > 0.9 * n) & (n > 10), "high_cardinality")))
    return profiles.select("column", F.explode(found).alias("finding"))


def partition_advice(profiles: DataFrame) -> DataFrame:
    """Columns with more than one and fewer than min(500, a tenth of the rows) values: worth partitioning by."""
    return profiles.where((F.col("unique_count") > 1) & (F.col("unique_count") < F.least(F.lit(500), F.col("n_rows") * 0.1))).select("column", "unique_count")


def group_counts(rows: DataFrame, by: str, top: int = 15, where: Column | None = None) -> DataFrame:
    """(value, n): the commonest values, ties by value, of all rows or those of a condition."""
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def breakdown(rows: DataFrame, group: str, value: str, top_pairs: int = 75, top_values: int = 5) -> DataFrame:
    """(group, total, value, n, position): the commonest pairs folded by group, each with its commonest values."""
    pairs = rows.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(F.col(group).alias("group"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    pairs = pairs.orderBy(F.desc("n"), "group", "value").limit(top_pairs)
    own = Window.partitionBy("group")
    pairs = pairs.withColumn("total", F.sum("n").over(own)).withColumn("position", F.row_number().over(own.orderBy(F.desc("n"), "value")))
    return pairs.where(F.col("position") <= top_values).select("group", "total", "value", "n", "position")


def sanitised(names: list[str]) -> list[str]:
    """Column names of letters, digits, CJK and ``_``; ``col_`` before a digit; repeats are numbered."""
    import re

    out: list[str] = []
    for name in names:
        n = re.sub(r"[^a-zA-Z0-9一-鿿_]", "_", name) or "col"
        n = f"col_{n}" if n[0].isdigit() else n
        i, base = 0, n
        while n in out:
            i += 1
            n = f"{base}_{i}"
        out.append(n)
    return out


def samples(rows: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """(column, samples): the first different filled values of each column in order."""
    v = cells(rows, columns).where("value != ''").distinct()
    first = v.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("_n") <= n)
    return first.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples"))


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The profile of each column with ``samples``."""
    d = profile(rows, columns)
    s = samples(rows, columns).withColumnRenamed("column", "_c")
    return d.join(s, F.col("column") == F.col("_c"), "left").select(*d.columns, F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def distinct_groups(rows: DataFrame, by: str, where: Column | None = None) -> DataFrame:
    """One row: the number of different values, null left out."""
    rows = rows if where is None else rows.where(where)
    return rows.select(by).where(F.col(by).isNotNull()).distinct().agg(F.count("*").alias("n_groups"))


def question_terms(query: str) -> list[str]:
    """Words of a question, and of its CJK characters all pairs, threes and single ones; with the column names that
    known words stand for."""
    import re

    q = query.lower()
    terms = re.findall(r"[a-zA-Z0-9]+", q)
    wide = re.findall(r"[一-鿿]", q)
    terms += ["".join(wide[i : i + n]) for n in (2, 3) for i in range(len(wide) - n + 1)] + wide
    return terms + [name for t in dict.fromkeys(terms) for name in COLUMN_WORDS.get(t, [])]


def match_columns(profiles: list[dict], query: str, top: int = 5) -> list[tuple[str, float]]:
    """Columns scored by the question's terms: their length in the name, and half of it for each sample that holds them."""
    terms = question_terms(query)
    scored = []
    for p in profiles:
        s = float(sum(len(t) for t in terms if t.lower() in p["column"].lower()))
        s += sum(0.5 * len(t) for x in p.get("samples", [])[:5] for t in terms if t.lower() in str(x).lower())
        if s > 0:
            scored.append((p["column"], s))
    return sorted(scored, key=lambda x: -x[1])[:top]


def asks_for_counts(query: str) -> bool:
    return any(w in query.lower() for w in COUNT_WORDS)


def describe_question(rows: DataFrame, query: str, columns: list[str], most: int = 8) -> DataFrame:
    """(position, column, data_type, unique_count, null_count, samples): the columns that match a question, the best first;
    without a match the first ones. Three samples each."""
    info = [r.asDict() for r in described(rows, columns).collect()]  # a row for each column
    by_name = {r["column"]: r for r in info}
    found = [c for c, _ in match_columns([by_name[c] for c in columns], query)] or columns
    out = [(i, c, by_name[c]["data_type"], by_name[c]["unique_count"], by_name[c]["null_count"], by_name[c]["samples"][:3]) for i, c in enumerate(found[:most], 1)]
    return rows.sparkSession.createDataFrame(out, "position int, column string, data_type string, unique_count long, null_count long, samples array<string>")


def table_question(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """(value, n): answers a question about a table by a grouped count, planned on the driver from a profile.

    Columns that match the question and have more than 20 values are dimensions, others measures; the first of each is
    taken, or the first two columns where none matches. A sample value of the measure that holds a term of the question
    becomes a filter. One job profiles all columns.
    """
    info = {r["column"]: r.asDict() for r in described(rows, columns).collect()}  # a row for each column
    return _planned(rows, query, columns, info)[1]


def _planned(rows: DataFrame, query: str, columns: list[str], info: dict[str, dict]) -> tuple[str, DataFrame]:
    """The column that ``table_question`` groups by, and its rows."""
    matched = [c for c, _ in match_columns([info[c] for c in columns], query)] or columns[:2]
    dimensions = [c for c in matched if info[c]["unique_count"] > 20]
    measures = [c for c in matched if info[c]["unique_count"] <= 20]
    group = (dimensions or measures)[0]
    measure = next((c for c in measures if c != group), None)
    if measure is None:
        return group, group_counts(rows, group)
    named = next((x for t in question_terms(query) for x in info[measure]["samples"] if t.lower() in x.lower()), None)
    if named is not None:
        return group, group_counts(rows, group, where=F.trim(F.col(measure).cast("string")) == named)
    return group, breakdown(rows, group, measure).select(F.col("group").alias("value"), F.col("total").alias("n")).distinct()


def search_sheet(rows: DataFrame, query: str, columns: list[str], operation: str = "describe", most: int = 8, sampled: int = 5) -> DataFrame:
    """(section, position, column, value, n): all that a question finds in a sheet.

    ``column``: the columns that match the question, the best first (all, where none does), ``most`` at most, with their type
    and number of values. ``top``: the five commonest values of each column that matches and holds text. ``finding``: what is
    odd in any column. ``group``: a grouped count as ``table_question`` plans it, if ``operation`` is "aggregate" or the
    question asks for counts. ``sample``, only for the operation "sample": the cells of the first ``sampled`` rows, ordered by
    the listed columns from left to right (null first, numbers as numbers), with the row's number in ``n``.

    One job profiles all columns; the driver sees a row for each. Blank cells are neither values nor samples' text: a null
    stays null. An empty sheet has columns of the type empty and nothing else.
    """
    if operation not in ("describe", "aggregate", "sample"):
        raise ValueError(f"unknown operation {operation!r}")
    spark, profiles = rows.sparkSession, described(rows, columns)
    info = {r["column"]: r.asDict() for r in profiles.collect()}  # a row for each column
    blank = {"data_type": "empty", "unique_count": 0, "n_rows": 0, "null_count": 0, "samples": []}
    info = {c: info.get(c, {"column": c} | blank) for c in columns}
    matched = [c for c, _ in match_columns([info[c] for c in columns], query)]
    listed = (matched or columns)[:most]
    kind = "section string, position int, column string, value string, n long"
    out = spark.createDataFrame([("column", i, c, info[c]["data_type"], info[c]["unique_count"]) for i, c in enumerate(listed, 1)], kind)
    text = [c for c in matched if info[c]["data_type"] == "string"]
    if text:
        out = out.unionByName(string_distribution(rows, text, 5).select(F.lit("top").alias("section"), "position", "column", "value", "n"))
    facts = spark.createDataFrame([(c, x["n_rows"], x["null_count"], x["unique_count"]) for c, x in info.items()], "column string, n_rows long, null_count long, unique_count long")
    odd = findings(facts).select(F.lit("finding").alias("section"), F.row_number().over(Window.orderBy("column", "finding")).alias("position"), "column", F.col("finding").alias("value"), F.lit(None).cast("long").alias("n"))
    out = out.unionByName(odd)  # a few rows a column
    if (operation == "aggregate" or asks_for_counts(query)) and any(x["n_rows"] for x in info.values()):
        group, counts = _planned(rows, query, columns, info)
        place = F.row_number().over(Window.orderBy(F.desc("n"), F.col("value").cast("string"))).alias("position")  # 75 rows at most
        out = out.unionByName(counts.select(F.lit("group").alias("section"), place, F.lit(group).alias("column"), F.col("value").cast("string").alias("value"), "n"))
    if operation == "sample":
        first = rows.select(*listed).orderBy(*listed).limit(sampled)
        first = first.withColumn("_n", F.row_number().over(Window.orderBy(*listed)))  # those few rows
        cell = F.posexplode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in listed])).alias("at", "c")
        out = out.unionByName(first.select(F.col("_n").cast("long").alias("n"), cell).select(F.lit("sample").alias("section"), (F.col("at") + 1).alias("position"), "c.column", "c.value", "n"))
    return out


def analysis_report(rows: DataFrame, columns: list[str], sheet: str) -> DataFrame:
    """(n, line): a compact report of a sheet in Markdown: its size, its columns, the distribution of each, its findings.

    All parts are a few rows a column; numbers of the first column stand in the order of ``columns``.
    """
    d = described(rows, columns)
    place = F.array_position(F.lit(columns), F.col("column"))
    line = lambda section, at, text: (F.lit(section).alias("section"), at.alias("at"), text.alias("line"))
    size = d.agg(F.max("n_rows").alias("r")).select(*line(0, F.lit(0).cast("long"), F.concat(F.lit(f"## Sheet: {sheet} ("), F.col("r").cast("string"), F.lit(f"行 x {len(columns)}列)"))))
    cell = F.concat(F.lit("| "), F.concat_ws(" | ", "column", "data_type", F.col("null_count").cast("string"), F.col("unique_count").cast("string"), F.array_join(F.slice("samples", 1, 3), ", ")), F.lit(" |"))
    table = d.select(*line(1, place, cell))
    kinds = d.select(F.col("column").alias("_c"), "data_type")
    num = numeric_distribution(rows, columns).join(kinds.where("data_type IN ('integer', 'float')"), F.col("column") == F.col("_c"))
    text = lambda c: F.format_string("%.2f", c)
    num = num.select(*line(2, place, F.concat(F.lit("- **"), "column", F.lit("**: 均值="), text("mean"), F.lit(", 中位数="), text("median"), F.lit(", 标准差="), text("std"), F.lit(", 范围=["), text("min"), F.lit(", "), text("max"), F.lit("]"))))
    top = string_distribution(rows, columns, 5).join(kinds.where("data_type = 'string'"), F.col("column") == F.col("_c"))
    top = top.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("position", F.concat("value", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("t")))).alias("ts"))
    top = top.select(*line(2, place, F.concat(F.lit("- **"), "column", F.lit("**: "), F.array_join("ts.t", ", "))))
    days = date_distribution(rows, columns).join(kinds.where("data_type = 'date'"), F.col("column") == F.col("_c"))
    days = days.select(*line(2, place, F.concat(F.lit("- **"), "column", F.lit("**: "), "earliest", F.lit(" ~ "), "latest")))
    noted = findings(d).select(*line(3, place, F.concat(F.lit("- ["), "finding", F.lit("] "), "column")))
    heads = rows.sparkSession.createDataFrame([(1, -2, "### 列结构"), (1, -1, "| 列名 | 类型 | 空值 | 唯一值 | 样本值 |"), (1, 0, "|---|---|---|---|---|"), (2, 0, "### 关键分布"), (3, 0, "### 数据发现")], "section int, at long, line string")
    parts = size.unionByName(table).unionByName(num).unionByName(top).unionByName(days).unionByName(noted).unionByName(heads)
    return parts.select(F.row_number().over(Window.orderBy("section", "at", "line")).alias("n"), "line")  # a few rows a column


def sheet_table(lines: DataFrame, key: str) -> DataFrame:
    """A typed table from rows of cells (key, line_no, cells): the first row of each key that is not blank is its header.

    Blank rows are skipped, short ones padded with null, more cells than names dropped; empty cells are null. All keys need
    one header; its names are sanitised. Columns whose filled values are all whole numbers become longs, all numbers doubles.
    """
    filled = lines.where(F.exists("cells", lambda c: F.trim(c) != ""))
    first = filled.groupBy(F.col(key).alias("_k")).agg(F.min("line_no").alias("_first"))
    d = filled.join(first, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    heads = d.where("line_no = _first").select("cells").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError("the sheets need one header")
    names = sanitised(heads[0]["cells"])
    text = [F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)]
    body = d.where("line_no > _first").select(F.col(key), "line_no", *text)
    whole = [F.coalesce(F.bool_and(F.col(n).rlike(r"^-?\d{1,18}$")), F.lit(False)).alias(f"w{i}") for i, n in enumerate(names)]
    real = [F.coalesce(F.bool_and(number(F.col(n)).isNotNull() | F.col(n).isNull()) & (F.count(n) > 0), F.lit(False)).alias(f"r{i}") for i, n in enumerate(names)]
    kinds = body.agg(*whole, *real).first()
    typed = [F.col(n).cast("long").alias(n) if kinds[f"w{i}"] else number(F.col(n)).alias(n) if kinds[f"r{i}"] else F.col(n) for i, n in enumerate(names)]
    return body.select(F.col(key), *typed)


def markdown_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, cells): rows of Markdown tables in texts, rules and headers' dashes left out."""
    d = texts.select(key, F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:\-]+$"))
    return d.select(key, "line_no", F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x)).alias("cells"))


def formatted_cell(value: Column) -> Column:
    """Null as empty, whole numbers without a point, others with four significant digits."""
    return F.when(value.isNull(), "").when(value == F.floor(value), F.format_string("%d", F.floor(value).cast("long"))).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.4g", value), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def excel_date(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)
