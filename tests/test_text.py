"""Text functions on literal cases, CJK among them."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, timeline


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_token_estimates(spark):
    assert one(spark, T.token_estimate(F.col("t")), t="这是测试 two words") == int(1.5 * 4 + 1.3 * 2)
    assert one(spark, T.context_token_estimate(F.col("t")), t="中文ab") == int(1.8 * 2 + 0.25 * 2)
    assert one(spark, T.token_estimate(F.col("t")), t="") == 0


def test_relation_type(spark):
    cases = {
        "甲 转账 乙 金额": ("资金往来", 0.9),
        "甲 配偶 乙 夫妻": ("亲属关系", 1.0),
        "甲 见 乙": ("相关", 0.5),
        "收到 500 美元": ("资金往来", 0.7),
    }
    for text, (kind, score) in cases.items():
        got = one(spark, T.relation_type(F.col("t")), t=text)
        assert (got["type"], round(got["score"], 6)) == (kind, score)


def test_document_type(spark):
    assert one(spark, T.document_type(F.col("t")), t="本院认为 判决如下") == "判决书"
    assert one(spark, T.document_type(F.col("t")), t="合同") == "其他"


def test_dates(spark):
    found = one(spark, T.timeline_dates(F.col("t")), t="于2024年3月5日，另于2023/12/01。2024年13月")
    assert {d["date"] for d in found} >= {"2024-03-05", "2023-12-01"}
    assert all("13" not in d["date"][5:7] for d in found)
    first = next(d for d in found if d["date"] == "2024-03-05")
    assert first["start"] == 1
    assert one(spark, T.merge_dates(F.col("t")), t="2024年3月5日")[0] == "2024-03-05"


def test_relative_dates(spark):
    cases = {"3天后": "2024-03-08", "2个月前": "2024-01-05", "1年后": "2025-03-05", "次日": "2024-03-06", "当天": "2024-03-05", "无": None}
    for text, want in cases.items():
        assert one(spark, T.relative_date(F.col("b"), F.col("t")), b="2024-03-05", t=text) == want
    assert one(spark, T.relative_date(F.col("b"), F.col("t")), b="2024-03", t="次日") is None


def test_legal_references_and_numbers(spark):
    text = "依据《刑法》第 266 条，共计 500 元，3笔"
    assert "刑法266" in one(spark, T.legal_references(F.col("t")), t=text)
    values = [n["value"] for n in one(spark, T.key_numbers(F.col("t")), t=text)]
    assert "500 元" in values and "3笔" in values


def test_names(spark):
    assert one(spark, T.normalise_name(F.col("t")), t=" 张　伟  ") == "张 伟"
    assert one(spark, T.normalise_id(F.col("t")), t="Session_ValidateToken!") == "session_validatetoken"
    assert one(spark, T.normalise_value(F.col("t")), t=" A (b) ") == "ab"
    for name, kind in {"北京市公安局": "organization", "张伟": "person", "": "unknown", "中山路": "location"}.items():
        assert one(spark, T.entity_type_from_name(F.col("t")), t=name) == kind
    for raw, kind in {"嫌疑人": "person", "ORG": "org", "org": "organization", "": "unknown"}.items():
        assert one(spark, T.entity_type(F.col("t")), t=raw) == kind


def test_complexity_and_ngrams(spark):
    for q, want in {"统计金额": "complex", "他们的关系": "medium", "他是谁": "simple", "你好": "medium"}.items():
        assert one(spark, T.question_complexity(F.col("t")), t=q) == want
    assert one(spark, T.ngram_words(F.col("t")), t="合同和诈骗的案件 x ab 什么") == ["合同诈骗", "合同诈", "骗案件", "合同", "诈骗", "案件", "ab"]


def test_wikilinks_and_budget(spark):
    got = one(spark, T.wikilinks(F.col("t")), t="[[a|b]] and [[c]]")
    assert [(x["target"], x["display"]) for x in got] == [("a", "b"), ("c", "c")]
    assert len(one(spark, T.budgeted(F.col("t"), 100), t="x" * 500)) < 130


def test_event_title(spark):
    assert one(spark, timeline.event_title(F.col("t")), t="后来公安局决定立案侦查，其他") == "后来公安局决定立案侦查"
    assert one(spark, timeline.event_title(F.col("t")), t="") == "未知事件"
    assert one(spark, timeline.event_title(F.col("t")), t="**Is Overlap:** False\n---\n后来公安局决定立案侦查，其他") == "后来公安局决定立案侦查"
    assert one(spark, timeline.event_title(F.col("t")), t="plain words " * 8) == "plain words plain words plain words plain words..."


def test_chunks():
    short, large, small = "短文本。" * 10, "长文本内容。" * 500, "第一段。这是测试内容，用于验证分段逻辑。" * 100
    assert len(chunking.segments(short, 100, 500)) == 1
    assert len(chunking.segments(large, 100, 500)) / len(chunking.segments(short, 100, 500)) > 5
    for text in (large, small):
        parts = chunking.segments(text, 100, 500)
        assert "".join(parts) == text and all(chunking.estimate(p) <= 500 for p in parts)
    assert chunking.segments("") == []
    joined = chunking.both(chunking.measure("ab c"), chunking.measure("d e"))
    assert joined[:2] == chunking.measure("ab cd e")[:2]


def test_chunk_table(spark):
    def plain_chunks(text):
        own = chunking.segments(text or "", 20, 60, "\n")
        out = []
        for i, s in enumerate(own):
            before = own[i - 1] if i else ""
            if i and chunking.estimate(before) > 8:
                w = before.split()
                k = max(1, int(len(w) * 8 / chunking.estimate(before)))
                s = " ".join(w[-k:]) + "\n\n" + s
            out.append(s)
        return out

    rng = random.Random(4)
    text = lambda n: "\n".join(" ".join(rng.choice(["stone", "river.", "tree!", "合同。"]) for _ in range(rng.randrange(1, 40))) for _ in range(n))
    rows = [(1, text(9)), (1, text(7)), (2, None), (3, ""), (4, text(3000)), (5, "word " * 5000), (None, text(4))]
    rows += [rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunking.chunk(d, least=20, most=60, overlap=8, paragraph="\n").collect()
    want = Counter((k, i, c) for k, t in rows for i, c in enumerate(plain_chunks(t), 1))
    assert Counter((r.doc_id, r.chunk_no, r.content) for r in got) == want and len({r.doc_id for r in got}) == 4
    assert all(r.is_overlap == ("\n\n" in r.content) for r in got)
    assert chunking.chunk(d.limit(0)).count() == 0


def test_question_names(spark):
    before = re.compile("[一-鿿]{2,4}(?=的|在|与|和|对|向|被|把|从|到|给)")
    stop = set(T.QUESTION_STOPWORDS)

    def plain(q):
        out = {m for m in before.findall(q) if m not in stop}
        for c in T.CONJUNCTIONS:
            if c in q:
                heads = [re.match("[一-鿿]{2,4}", p.strip()) for p in q.split(c)]
                out |= {m[0] for m in heads if m and m[0] not in stop | set(T.CONJUNCT_STOPWORDS)}
        out |= set(re.findall("[「\"'《【](.{2,10})[」\"'》】]", q))
        about = re.search("(?:关于|涉及|有关)(.{2,10}?)(?:的|问题|事情|案件|事件)", q)
        return sorted(out | ({about[1]} if about else set()))

    questions = ["张伟和李娜之间是什么关系", "为什么的动机", "关于合同诈骗案件", "《某某案》在哪", "Anna 与 Bo", "", "张伟、李娜及王芳", "案件和证据"]
    for q in questions:
        assert one(spark, T.question_names(F.col("t")), t=q) == plain(q), q
    d = spark.createDataFrame([("q", ["a", "b", "c", "d"])], "q string, n array<string>").select(T.sub_queries(F.col("q"), F.col("n"), F.lit("comparative"), F.lit("complex")).alias("s")).first().s
    assert [(x.query, x.layer, x.search, x.priority) for x in d] == [("q", "L1", "hybrid", 1), ("a", "L0", "graph", 2), ("b", "L0", "graph", 2), ("c", "L0", "graph", 2), ("a b 关系", "L1", "hybrid", 2), ("a 矛盾 不一致", "L1", "keyword", 3)]


def test_overlap(spark):
    assert one(spark, chunking.overlap_length(F.col("a"), F.col("b")), a="xx 0123456789", b="0123456789 yy") == 10
    assert one(spark, chunking.overlap_length(F.col("a"), F.col("b")), a="abc", b="abc") == 0


def test_questions_and_headings(spark):
    for q, want in {"表格里有几个": "tabular", "两份笔录矛盾": "comparative", "他们的关系": "relational", "谁": "factual"}.items():
        assert one(spark, T.question_type(F.col("t")), t=q) == want
    assert one(spark, T.start_level(F.lit("evidential"), F.lit("medium")), t="") == "L2"
    assert one(spark, T.heading(F.col("t")), t="序\n 第一章 开端\n第二章") == "第一章 开端"
    assert one(spark, T.heading(F.col("t")), t="chapter 3") == "chapter 3" and one(spark, T.heading(F.col("t")), t="no") is None
    assert one(spark, T.json_object(F.col("t")), t='so: ```json\n{"a": 1}\n``` ok') == '{"a": 1}'
    assert one(spark, T.json_object(F.col("t")), t='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}' and one(spark, T.json_object(F.col("t")), t="none") is None
    assert one(spark, T.json_object(F.col("t")), t='{"a": "}"} and {"b": 2}') == '{"a": "}"}' and one(spark, T.json_object(F.col("t")), t='{"a": 1') is None
