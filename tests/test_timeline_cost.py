"""Titles and dates: what stands twice in an expression is computed once, and long searches are made only where they may find."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import timeline


def test_titles_as_the_patterns_alone_give_them(spark):
    texts = ["2024年1月2日，张伟见李娜", "公安局依法对张伟立案侦查。另行通知", "市检察院见张伟，法院将判决如下", "对账目进行核对，已结", "派出所", "立案", "x" * 60]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", timeline.event_title(F.col("t")).alias("title")).collect()
    for r in rows:
        found = [m.group(1).strip() for p in T.TITLE_PATTERNS if (m := re.search(p, r.t)) and 5 <= len(m.group(1).strip()) <= 50]
        assert r.title == (found[0] if found else r.t if len(r.t) <= 50 else r.t[:50] + "...")


def test_a_long_text_without_the_words_of_a_title_takes_no_square_search(spark):
    d = spark.range(1).select(F.repeat(F.lit("甲乙丙丁"), 15_000).alias("t"))
    d.select(F.length(timeline.event_title(F.lit("对张伟进行询问")))).collect()
    began = time.time()
    assert len(d.select(timeline.event_title(F.col("t")).alias("title")).first().title) == 53
    assert time.time() - began < 5


def test_many_dates_and_relative_days(spark):
    days = [f"2024年{m}月{d}日" for m in range(1, 13) for d in range(1, 28)]
    text = "，见。".join(days)
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(T.match_positions(F.col("t"), r"\d+年").alias("m")).collect()
    assert [x.start for x in got[0].m] == [m.start() for m in re.finditer(r"\d+年", text)] and got[1].m == [] and got[2].m is None
    moved = spark.createDataFrame([("3天后",), ("99999999999天后",), ("99999999年后",), ("次日",), ("当天",), ("x",), ("2个月前",)], "t string").select(T.relative_days(F.col("t")).alias("n")).collect()
    assert [r.n for r in moved] == [3, None, None, 1, 0, None, -60]
