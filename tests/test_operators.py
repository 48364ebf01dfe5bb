"""Operators on small literal tables."""

import random

from pyspark.sql import functions as F

from docloom.operators import conversation, entities, fusion, graph, search, tabular, vectors, wiki
from docloom.operators.ordering import numbered, with_previous
from docloom.sources import files, layers


def test_confidence_and_relevance(spark):
    d = spark.createDataFrame([(s, k) for s in (0.8, 0.6, 0.4, 0.1) for k in (0.0, 0.7)], "s double, k double")
    got = {(r.s, r.k): r.c for r in d.select("s", "k", fusion.confidence(F.col("s"), F.col("k")).alias("c")).collect()}
    assert got[(0.8, 0.0)] == "EXTRACTED" and got[(0.1, 0.0)] == "AMBIGUOUS" and got[(0.1, 0.7)] == "INFERRED"
    r = spark.range(1).select(*[fusion.relevance("L0", F.lit(n)).alias(f"a{n}") for n in (0, 3, 10)], *[fusion.relevance("L2", F.lit(x)).alias(n) for n, x in (("b", -0.5), ("c", 0.7), ("d", 2.0))], fusion.drill_down(F.lit(0.35)).alias("e"), fusion.drill_down(F.lit(0.45)).alias("f")).first()
    assert r.a0 < r.a3 < r.a10 and (r.b, r.c, r.d, r.e, r.f) == (0.0, 0.7, 1.0, True, False)


def test_communities(spark):
    edges = spark.createDataFrame([("e1", "e2", 0.9), ("e3", "e4", 0.9)], "src string, dst string, weight double")
    for found in (graph.components(edges).collect(), graph.label_propagation(edges).collect()):
        c = {r[0]: r[1] for r in found}
        assert c["e1"] == c["e2"] != c["e3"] == c["e4"]
    empty = edges.limit(0)
    assert graph.components(empty).count() == 0 and graph.label_propagation(empty).count() == 0


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4)], "src long, dst long")
    assert graph.shortest_path(edges, 1, 4).first()["path"] == [1, 5, 4]
    assert graph.shortest_path(edges, 1, 99).count() == 0
    assert {r.node: r.distance for r in graph.within(edges, spark.createDataFrame([(1,)], "node long"), 1).collect()} == {1: 0, 2: 1, 5: 1}


def test_greedy_merge_is_ordered(spark):
    rows = [("k", 1, "张伟", "unknown", ["a", "b", "c", "d"], {"x": "1"}), ("k", 2, "张伟（嫌疑人）", "嫌疑人", ["e"], {"x": "2", "y": "3"}), ("k", 3, "李四", "人物", ["f"], None), ("k", 4, "张伟", "unknown", ["g"], {})]
    d = spark.createDataFrame(rows, "kb_id string, seq long, name string, type string, chunks array<string>, attributes map<string,string>")
    found, aliases, chunks = entities.merge_greedy(d)
    got = {r.name: r for r in found.collect()}
    assert set(got) == {"张伟", "李四"}
    assert got["张伟"].mention_count == 3 and got["张伟"].type == "person" and got["张伟"].attributes == {"x": "1", "y": "3"} and got["李四"].attributes == {}
    assert [(r.name, r.alias) for r in aliases.collect()] == [("张伟", "张伟（嫌疑人）")]
    assert [r.chunk for r in chunks.where("name = '张伟'").orderBy("seq", "chunk").collect()] == ["a", "b", "c", "e", "g"]


def test_exact_merge(spark):
    rows = [("k", 1, " Ann", 1, "d1", {"x": "1"}), ("k", 2, "ann", 5, "d2", {"x": "2"}), ("k", 3, "Bo", 2, None, None), (None, 4, "ann", 1, "d1", {})]
    d = spark.createDataFrame(rows, "kb_id string, seq long, name string, importance int, doc_id string, attributes map<string,string>")
    got = sorted(map(tuple, entities.merge_exact(d).collect()), key=str)
    assert got == sorted([("k", "entity_0001", " Ann", 5, 2, 2, 2, {"x": "2"}), ("k", "entity_0002", "Bo", 2, 1, 1, 0, {}), (None, "entity_0001", "ann", 1, 1, 1, 1, {})], key=str)
    assert entities.merge_exact(d.limit(0)).count() == 0


def test_endpoints_and_contradictions(spark):
    ents = spark.createDataFrame([(1, "entity_9999", "张三", ["小张"]), (2, "e2", "李四", None), (3, "entity_10000", "张三", None)], "seq int, entity_id string, name string, aliases array<string>")
    rel = spark.createDataFrame([("小张", "认识", "李四"), ("无名", "认识", "张三")], "subject string, predicate string, object string")
    got = {r.subject: (r.subject_id, r.object_id) for r in entities.endpoint_ids(rel, ents).collect()}
    assert got == {"小张": ("entity_9999", "e2"), "无名": (None, "entity_10000")}
    m = spark.createDataFrame([("a", {"age": "30"}), ("a", {"age": " 31"}), ("a", {"hobby": "x"}), ("b", {"age": "1"})], "name string, attributes map<string,string>")
    rows = entities.contradictions(m).collect()
    assert [(r.name, r.attribute, r.n_values, r.confidence) for r in rows] == [("a", "age", 2, 0.7)]


def test_numbers_and_previous_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), rng.randrange(50), i) for i in range(400)]
    d = numbered(spark.createDataFrame(rows, "g string, o int, i long").repartition(5), ["g"], ["o", "i"])
    got = {r.i: r for r in with_previous(d, ["g"], "n", ["i"], 2).collect()}
    for g in ("a", None, "b"):
        own = [i for _, i in sorted((o, i) for x, o, i in rows if x == g)]
        assert [got[i].n for i in own] == list(range(1, len(own) + 1))
        assert [(got[i].i_1, got[i].i_2) for i in own] == [(own[k - 1] if k else None, own[k - 2] if k > 1 else None) for k in range(len(own))]
    assert numbered(d.drop("n").limit(0), ["g"], ["o"]).count() == 0


def test_pairs_of_a_large_record(spark):
    rows = [(1, i) for i in range(300)] * 2 + [(2, 1), (2, 2), (None, 5), (None, 6), (3, None)]
    got = graph.paired(spark.createDataFrame(rows, "r long, i long"), "r", "i").collect()
    assert sorted(map(tuple, got)) == sorted([(1, a, b) for a in range(300) for b in range(a + 1, 300)] + [(2, 1, 2)])


def test_claims_without_terms(spark):
    d = spark.createDataFrame([(1, "abcd efgh"), (2, "abcd"), (2, "abcd")], "k long, t string")
    assert conversation.claim_check("a b", d, "k", "t").count() == 0
    assert sorted(map(tuple, conversation.claim_check("abcd zzzz", d, "k", "t").collect())) == [("abcd", 2, True), ("zzzz", 0, False)]


def test_tree_of_any_depth(spark):
    rows = [(str(i), str(i - 1) if i else None, f"t{i}") for i in range(25)] + [("x", "y", "loop"), ("y", "x", "loop")]
    got = {r.id: r.depth for r in graph.tree(spark.createDataFrame(rows, "id string, parent_id string, title string"), F.col("parent_id").isNull()).collect()}
    assert got == {str(i): i for i in range(25)}


def test_pages_of_matching_lines(spark):
    d = spark.createDataFrame([(1, "a hit\nb\nHIT again"), (2, None), (3, "hit"), (4, "")], "doc_id long, text string")
    pages = [[(r.doc_id, r.line_no, r.before, r.total) for r in search.grep_page(d, "hit", 1, o, 2).collect()] for o in (0, 2, 4)]
    assert pages == [[(1, 1, "", 3), (1, 3, "b", 3)], [(3, 1, "", 3)], []]


def test_tree_with_cycles(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (1, 2, "again"), (3, 2, "c"), (5, 6, "x"), (6, 5, "y"), (7, 7, "self")], "id long, parent_id long, title string")
    found = sorted((r.id, r.depth, r.path, r.is_leaf) for r in graph.tree(d, F.col("parent_id").isNull()).collect())
    assert found == [(1, 0, "a", False), (2, 1, "a/b", False), (3, 2, "a/b/c", True)]


def test_vectors_with_nulls_and_repeated_keys(spark):
    kind = "vec_id long, embedding array<double>"
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0])], kind)
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, None), (None, [1.0, 0.0])], "query long, embedding array<double>")
    assert [(r["query"], r.vec_id) for r in vectors.nearest_to_many(d, asked, 2).orderBy("query", "position").collect()] == [(7, 1), (7, 3)]
    new = [(3, [3.0, 4.0]), (3, [0.0, 1.0]), (4, None), (4, [0.0, 5.0]), (None, [1.0, 1.0]), (5, None)]
    for rows in (new, new[::-1]):
        found = {r.vec_id: r.embedding for r in vectors.append_vectors(d, spark.createDataFrame(rows, kind), "vec_id").collect()}
        assert found == {1: [1.0, 0.0], 2: None, 3: [0.6, 0.8], 4: [0.0, 1.0], 5: None}


def test_index_is_idempotent(spark, tmp_path):
    rows = [(i, f"w{i % 7} common w{i % 3} text") for i in range(60)] + [(3, "w3 common again"), (99, None)]
    d = spark.createDataFrame(rows[:60], "doc_id long, text string")
    for again in (d, d.union(d)):
        search.write_index(again, str(tmp_path / "i"))
        got = [(r.doc_id, round(r["rank"], 9)) for r in search.bm25_of_index(spark, str(tmp_path / "i"), "W1 common", 20).collect()]
        assert got == [(r.doc_id, round(r["rank"], 9)) for r in search.bm25(d, "W1 common", 20).collect()] and len(got) > 10
    assert search.bm25(d, "...", 5).count() == 0 and search.bm25_of_index(spark, str(tmp_path / "i"), "nowhere", 5).count() == 0


def test_layers(spark, tmp_path):
    rows = [("k1", "d1", "c1", 3, "a\n---\nb"), ("k2", "d2", "c2", 1, "x"), ("k1", "d1", "c1", 3, "a\n---\nb")]
    chunks = spark.createDataFrame(rows, "kb_id string, doc_id string, chunk_id string, token_count long, content string")
    for _ in range(2):
        layers.save_chunks(chunks, str(tmp_path))
    layers.save_chunks(chunks.where("kb_id = 'k2'").withColumn("content", F.lit("new")), str(tmp_path))  # leaves the other alone
    assert sorted((r.chunk_id, r.content) for r in layers.load_chunks(spark, str(tmp_path)).collect()) == [("c1", "a\n---\nb"), ("c2", "new")]
    layers.save_layer(chunks.select("kb_id", "content"), str(tmp_path), "l1")
    assert layers.load_layer(spark, str(tmp_path), "l1", "content string, kb_id string").count() == 3
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.md").write_text("# hi\nthere")
    assert [r.text for r in layers.read_texts(spark, str(tmp_path / "t")).collect()] == ["# hi\nthere"]


def test_sheet_table(spark):
    rows = [(1, 0, ["", " "]), (1, 1, ["n", "x y", "x-y"]), (1, 2, ["1", "a"]), (1, 3, ["2", "", "2.5", "more"])]
    d = tabular.sheet_table(spark.createDataFrame(rows, "k long, line_no int, cells array<string>"), "k")
    assert d.dtypes == [("k", "bigint"), ("n", "bigint"), ("x_y", "string"), ("x_y_1", "double")] and sorted(map(tuple, d.collect())) == [(1, 1, "a", None), (1, 2, None, 2.5)]


def test_profile(spark):
    rows = [("1", "1.5", "2024-01-01", "x", None), ("0", "2", "2024-02-01", "y", " ")] * 6
    got = {r["column"]: r for r in tabular.profile(spark.createDataFrame(rows, "b string, f string, d string, s string, e string"), list("bfdse")).collect()}
    assert {k: v.data_type for k, v in got.items()} == {"b": "boolean", "f": "float", "d": "date", "s": "string", "e": "empty"}
    assert got["e"].null_count == 12 and got["s"].unique_count == 2
    assert tabular.sanitised(["1a", "x y", "x-y", "金额"]) == ["col_1a", "x_y", "x_y_1", "金额"]
    cells = spark.createDataFrame([(3.0,), (3.14159,), (None,)], "v double").select(tabular.formatted_cell(F.col("v")).alias("c")).collect()
    assert [r.c for r in cells] == ["3", "3.142", ""]


def test_memory(spark):
    mem = spark.createDataFrame([("k", "t", "a", ["s1"], 0.5)], "kb_id string, memory_type string, content string, sessions array<string>, score double")
    new = spark.createDataFrame([("k", "t", "a", "s2", 0.6), ("k", "t", "b", "s1", 0.4)], "kb_id string, memory_type string, content string, session string, score double")
    got = {r.content: r for r in conversation.upsert_memory(mem, new).collect()}
    assert sorted(got["a"].sessions) == ["s1", "s2"] and round(got["a"].score, 6) == 0.7 and got["b"].score == 0.4
    assert conversation.query_tokens("合同 ab") == ["ab", "合同", "同 "]


def test_vectors(spark):
    d = spark.createDataFrame([("a", "hello world"), ("b", "hello there"), ("c", ""), ("d", None)], "k string, t string")
    v = vectors.hash_embedding(d, "k", "t")
    assert all(len(r.embedding) == 256 for r in v.collect())
    q = v.where("k = 'a'").first().embedding
    assert [r.k for r in vectors.nearest(v, q, 2, "k").collect()] == ["a", "b"]
    assert vectors.without_documents(v.withColumnRenamed("k", "doc_id"), spark.createDataFrame([("a",)], "doc_id string")).count() == 3


def test_hash_vectors_against_a_plain_loop(spark, monkeypatch):
    import hashlib

    import numpy as np

    def plain(text):
        v = np.zeros(256)
        for n in (2, 3, 4):
            for i in range(max(1, len(text) - n + 1)):
                h = hashlib.md5(text[i : i + n].encode()).digest()
                v[int.from_bytes(h[:4], "little") % 256] += 1.0
                v[int.from_bytes(h[4:8], "little") % 256] -= 0.5
        for word in text.split():
            v[int.from_bytes(hashlib.md5(word.lower().encode()).digest()[:4], "little") % 256] += 2.0
        return v / (np.linalg.norm(v) or 1)

    monkeypatch.setattr(vectors, "MEMO_GRAMS", 50)
    texts = ["", "a", "Hello hello World", "合同 诈骗 Ärger\nx", "word " * 300, "x\x1cy z"]
    assert all(np.allclose(vectors.hash_vector(t), plain(t)) for t in texts)
    from conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r.embedding for r in vectors.hash_embedding(docs, "doc_id", "text").collect()}
    assert all(np.allclose(got[r.doc_id], plain(r.text or ""), atol=1e-6) for r in docs.limit(40).collect())


def test_front_matter_and_health(spark):
    r = spark.createDataFrame([("---\ntitle: A: b\nkind: x\n---\nbody",)], "t string").select(wiki.front_matter(F.col("t")).alias("m"), wiki.slug(F.lit(" A b/c ")).alias("s"), wiki.health_score(F.lit(1), F.lit(1), F.lit(1), F.lit(1)).alias("h")).first()
    assert r.m == {"title": "A: b", "kind": "x"} and r.s == "a-b-c" and r.h == 0.82


def test_csv_and_plain_text():
    assert files.csv_rows("a,b\n金额,2\n".encode("gbk")) == [["a", "b"], ["金额", "2"]]
    assert files.plain_text(("这是一个测试文档的内容文字" + "\nx").encode("gbk")) == "这是一个测试文档的内容文字"


def test_markdown_rows(spark):
    d = spark.createDataFrame([(1, "text\n| a | b |\n|---|---|\n| 1 |  x y |\nend")], "k long, t string")
    assert [r.cells for r in tabular.markdown_rows(d, "k", "t").collect()] == [["a", "b"], ["1", "x y"]]


def test_nearest_in_blocks(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 8))
    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = vectors.nearest_to_many(d, d.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query"), 3, block=4).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(i), p) for q in range(0, 60, 5) for p, i in enumerate(np.argsort(-(u @ u[q]))[:3], 1)}
    assert {(r.query, r.vec_id, r.position) for r in got} == want
    assert vectors.nearest_to_many(d, d.limit(0).withColumnRenamed("vec_id", "query"), 3).count() == 0
