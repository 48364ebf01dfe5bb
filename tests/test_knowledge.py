"""Linking and assessment operators against literal cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import assess, entities, linking


def test_named_in_long_text(spark):
    texts = [(1, "x" * 510 + "Anna Berg" + "y" * 700 + "Anna"), (2, ""), (3, None), (4, "An")]
    d = spark.createDataFrame(texts, "id long, t string")
    names = spark.createDataFrame([("Anna Berg",), ("Anna",), ("",), (None,), ("An",)], "name string")
    got = {(r.id, r.name, r.at) for r in linking.named_in(d, "id", "t", names).collect()}
    assert got == {(1, "Anna Berg", 510), (1, "Anna", 510), (1, "An", 510), (4, "An", 0)}
    assert linking.named_in(d, "id", "t", names.limit(0)).count() == 0


def test_find_names(spark):
    e = spark.createDataFrame([("张伟", 1), ("张伟公司", 2), ("Ann", 3)], "name string, o long")
    asked = spark.createDataFrame([("张伟",), ("ANN",), ("公司",), ("Anne",), ("zz",), ("",)], "q string")
    got = {r.query: (r.name, r.how) for r in linking.find_names(asked, "q", e, "name", "o").collect()}
    assert got == {"张伟": ("张伟", "exact"), "ANN": ("Ann", "exact"), "公司": ("张伟公司", "partial"), "Anne": ("Ann", "partial")}


def test_references_and_prefixes(spark):
    docs = spark.createDataFrame([("d1",), ("d10",)], "doc string")
    refs = spark.createDataFrame([(1, "See D10, p. 3"), (1, "other"), (1, "none"), (2, "d1"), (2, None)], "k long, ref string")
    checked = linking.verified_references(refs, "k", "ref", docs, "doc")
    assert sorted((r.k, r.reference or "", r.verified) for r in checked.collect()) == [(1, "See D10, p. 3", True), (1, "none", False), (1, "other", False), (2, "", False), (2, "d1", True)]
    assert [tuple(r) for r in linking.reference_warnings(checked, "k").collect()] == [(1, 2, 3)]
    got = {r.k: r.doc for r in linking.by_prefix(spark.createDataFrame([(1, "d10_chunk"), (2, "d1_chunk"), (3, "x"), (4, None)], "k long, t string"), "k", "t", docs, "doc").collect()}
    assert got == {1: "d10", 2: "d1", 3: None, 4: None}


def test_link_first(spark):
    rows = spark.createDataFrame([(1, "[[Ann]] met Anna, Ann (B.) and Ann."), (2, "plain"), (3, None)], "k long, t string")
    terms = spark.createDataFrame([(1, "Ann", "p/ann"), (1, "Ann (B.", "p/b"), (3, "x", "y")], "k long, term string, target string")
    got = {r.k: r.text for r in linking.link_first(rows, "k", "t", terms).collect()}
    assert got == {1: "[[Ann]] met Anna, [[p/b|Ann (B.]]) and [[p/ann|Ann]].", 2: "plain", 3: None}


def _folded(rows):
    found = []
    for _, name in rows:
        own = next((e for e in found if name in e[0] or e[0] in name), None)
        if own is None:
            found.append([name, 1, []])
        else:
            own[1] += 1
            if name != own[0] and name not in own[2]:
                own[2].append(name)
    return sorted((n, c, tuple(a)) for n, c, a in found)


def test_greedy_merge_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(kb, i, "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))) for kb in ("k1", None) for i in range(120)]
    # long names first, so that entities are many and hang on one another
    rows += [("k3", i, "".join(rng.choice("abcd") for _ in range(6 - i // 40))) for i in range(200)]
    d = spark.createDataFrame([(k, i, n, "unknown", [f"c{i}"], {}) for k, i, n in rows], "kb_id string, seq long, name string, type string, chunks array<string>, attributes map<string,string>")
    found, aliases, chunks = entities.merge_greedy(d)
    found, aliases = found.collect(), aliases.orderBy("seq").collect()
    for kb in ("k1", None, "k3"):
        own = [(r.name, r.mention_count, tuple(a.alias for a in aliases if (a.kb_id, a.name) == (kb, r.name))) for r in found if r.kb_id == kb]
        assert sorted(own) == _folded([(i, n) for k, i, n in rows if k == kb])
        assert all(r.n_aliases == len(a) for r, (*_, a) in zip([r for r in found if r.kb_id == kb], own, strict=True))
    assert chunks.count() == len(rows) and all(x.count() == 0 for x in entities.merge_greedy(d.limit(0)))


def _asked(states, cooldown=5, most=3):
    out, last, count = [], -99, 0
    for n, why in enumerate(states, 1):
        if why and n > last + cooldown and count < most:
            out.append((n, why))
            last, count = n, count + 1
    return out


def test_decision_points(spark):
    rng = random.Random(5)
    rows, want = [], []
    for s in range(4):
        why = []
        for i in range(1, 60):
            sat, con = rng.random() < 0.1, rng.randint(0, 2)
            rows.append((s, i, i, 3 + i % 4, sat, con, 20, 5, 0))
            why.append(None if i < 12 else "info_saturated" if sat else "contradiction" if con == 2 else "search_space_large" if 3 + i % 4 <= 5 and i >= 15 else "missing_dimension")
        want += [(s, n, w) for n, w in _asked(why)]
    d = spark.createDataFrame(rows, "s long, o long, iteration int, docs_read int, saturated boolean, contradictions int, docs_with_results int, entities int, relations int")
    assert sorted(map(tuple, assess.decision_points(d, "s", "o").collect())) == want


def _stripped(text, is_head):
    lines = text.split("\n")
    blocks, i = [], 0
    while i < len(lines):
        if not is_head(lines[i].strip()):
            i += 1
            continue
        j = i
        while j + 1 < len(lines) and is_head(lines[j + 1].strip()):
            j += 1
        blocks.append((i, j))
        i = j + 1
    if not blocks:
        return text
    at = blocks[0][0]
    for n, (a, b) in enumerate(blocks):
        if b - a >= 2:
            again = [x for x in range(a + 1, b + 1) if lines[x].strip() == lines[a].strip()]
            at = again[0] if again else blocks[n + 1][0] if n + 1 < len(blocks) else b
            break
    return "\n".join(lines[at:]).strip()


def test_toc(spark):
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(["H1", "H2", "H3", "body", "", " H4 "]) for _ in range(rng.randint(1, 14))) for _ in range(300)] + [""]
    d = spark.createDataFrame(list(enumerate([*texts, None])), "k long, t string")
    got = {r.k: r.text for r in assess.without_toc(d, "k", "t", "^H").collect()}
    assert [got[i] for i in range(len(texts))] == [_stripped(t, lambda x: x.startswith("H")) for t in texts] and got[len(texts)] is None


def test_banners(spark):
    rows = [("s", 0, c, "Title") for c in range(4)] + [("s", 1, c, v) for c, v in enumerate(["a", "b", "c", "d"])] + [("s", 2, c, "x") for c in range(4)]
    cells = spark.createDataFrame(rows, "sheet string, row int, col int, value string")
    merges = spark.createDataFrame([("s", 0, 4), ("s", 1, 2)], "sheet string, row int, col_span int")
    assert [tuple(r) for r in assess.banner_rows(cells, merges).collect()] == [("s", 0, "Title")]


def test_scalar_checks(spark):
    one = spark.range(1)
    r = one.select(
        assess.rerank_scores(F.lit("```json\n[{\"score\": 3}, {\"x\": 1}]\n```")).alias("a"),
        assess.rerank_scores(F.lit("so: [1, 2.5]")).alias("b"),
        assess.rerank_scores(F.lit("none")).alias("c"),
        assess.template_type(F.lit("证据清单"), F.lit(None)).alias("d"),
        assess.template_type(F.lit("A Model"), F.lit("x"), True).alias("e"),
        assess.template_type(F.lit("A Model"), F.lit("x")).alias("f"),
        assess.formatted_number(F.lit(45292.0), F.lit("yyyy-mm-dd")).alias("g"),
        assess.formatted_number(F.lit(1234.5), F.lit("€#,##0.00")).alias("h"),
        assess.interaction_state(F.lit(0.2), F.lit(3)).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == ([3.0, 5.0], [1.0, 2.5], None, "evidence", "method", "default", "2024-01-01", "$1,234.50", "low_relevance")


def test_named_in_both_ways(spark):
    """Automaton and substrings against a plain search: names in names, characters beyond 16 bits, keys that repeat."""
    r = random.Random(3)
    alphabet = "ab张😀 "
    names = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 4))) for _ in range(60)})
    rows = [(r.choice([1, 2, 3, None, *range(10, 60)]), "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 7, 600])))) for _ in range(80)] + [(9, None)]
    want = {}
    for key, text in rows:
        for name in names:
            if text and name in text:
                want[key, name] = min(want.get((key, name), 10**9), text.index(name))
    d, n = spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame([(x,) for x in names], "name string")
    for most in (10**6, 40, 0):  # one automaton, several, substrings
        assert {(x.id, x.name): x["at"] for x in linking.named_in(d, "id", "t", n, most_chars=most).collect()} == want


def test_cascade_of_any_depth(spark):
    """All tables of a knowledge base, child first; two parents of one table, nulls, repeated rows, cycles refused."""
    def t(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "documents": t([("d1", "a"), ("d2", "b"), ("d3", None), ("d2", "b")], "doc_id string, kb_id string"),
        "parts": t([("d1", 1), ("d2", 2), (None, 3), ("d9", 4)], "doc_id string, n long"),
        "sessions": t([("s1", "a"), ("s2", "b")], "session_id string, kb_id string"),
        "messages": t([("s1", "x"), ("s2", "y"), ("s2", "z")], "session_id string, text string"),
        "entities": t([("e1", "a"), ("e2", "b")], "name string, kb_id string"),
        "empty": t([], "name string, kb_id string"),
    }
    left = assess.without_kb(tables, t([("a",), ("a",), (None,)], "kb_id string"))
    got = {n: sorted(tuple(str(v) for v in r) for r in d.collect()) for n, d in left.items()}
    assert got == {
        "documents": [("d2", "b"), ("d2", "b"), ("d3", "None")],
        "parts": [("None", "3"), ("d2", "2"), ("d9", "4")],
        "sessions": [("s2", "b")],
        "messages": [("s2", "y"), ("s2", "z")],
        "entities": [("e2", "b")],
        "empty": [],
    }
    chain = {n: t([(i, i - 1 if i else None) for i in range(4)], "id long, up long") for n in "wxyz"}
    links = [("x", "up", "w", "id"), ("y", "up", "x", "id"), ("z", "up", "y", "id"), ("z", "id", "w", "id")]
    left = assess.cascaded(chain, links, {"w": t([(0,)], "id long")})
    assert {n: sorted(r.id for r in d.collect()) for n, d in left.items()} == {"w": [1, 2, 3], "x": [0, 2, 3], "y": [0, 1, 3], "z": [1, 2]}
    for bad in ([*links, ("w", "up", "z", "id")], [("w", "up", "w", "id")], [("w", "up", "v", "id")]):
        with pytest.raises(ValueError):
            assess.cascaded(chain, bad, {})


def test_expanded_keeps_summaries_that_are_alike(spark):
    records = [("d", ["c1", "c2"], "Ann met Bo", ["Ann", "Bo", "Ann"]), ("d", ["c1", "c2"], "Ann met Bo", ["Ann", "Bo"]), ("e", [], "Ann", ["Ann"])]
    r = spark.createDataFrame(records, "doc_id string, chunk_ids array<string>, summary string, names array<string>")
    got = entities.expanded(spark.createDataFrame([("Ann",), ("Ann",)], "name string"), r).collect()
    assert sorted((x.name, x.doc_id, x.chunk_id or "") for x in got) == [("Ann", "d", "c1")] * 2 + [("Ann", "d", "c2")] * 2 + [("Ann", "e", "")]


def test_references_are_checked_against_every_brand(spark):
    from conftest import SMALL
    from docloom.plans.knowledge_queries import verified_references

    parts = spark.read.parquet(f"{SMALL}/part.parquet").collect()
    brands = {p.p_brand.lower() for p in parts}
    want = {p.p_partkey: any(b in f"{p.p_name} {p.p_brand}".lower() for b in brands) for p in parts}
    assert {r.p_partkey: r.verified for r in verified_references(spark, SMALL).collect()} == want
