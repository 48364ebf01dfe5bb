"""Affinity of pairs and best partners, against plain Python over all pairs."""

import math
import random
from itertools import combinations

import pytest

from docloom.operators import cells, graph, partners, wedges


def plain(edges, documents=()):
    weight, near, docs = {}, {}, {}
    for a, b, w in edges:
        if a is not None and b is not None and a != b:
            pair = (min(a, b), max(a, b))
            weight[pair] = weight.get(pair, 0) + w
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for name, doc in documents:
        if name is not None and doc is not None:
            docs.setdefault(name, set()).add(doc)
    out = {}
    for a, b in combinations(sorted(set(near) | set(docs)), 2):
        aa = sum(1 / math.log(len(near[v])) for v in near.get(a, set()) & near.get(b, set()))
        x, y = docs.get(a, set()), docs.get(b, set())
        shared = len(x & y) / min(len(x), len(y)) if x and y else 0.0
        direct = min(0.3 + 0.1 * weight[a, b], 0.8) if (a, b) in weight else 0.0
        out[a, b] = aa, shared, max(direct, min(aa / 5, 0.6), 0.7 * shared)
    return out


def best(edges, n):
    around = {}
    for (a, b), (_, _, score) in plain(edges).items():
        if score > 0:
            around.setdefault(a, []).append((-round(score, 9), b))
            around.setdefault(b, []).append((-round(score, 9), a))
    return {(x, y, i + 1): round(-s, 6) for x, found in around.items() for i, (s, y) in enumerate(sorted(found)[:n])}


def graphs():
    rng = random.Random(3)
    yield "random", [(rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 5))) for _ in range(150)]
    # hubs over a sparse ground: few direct edges, many wedges
    yield "hubs", [(rng.choice([0, 1, 2]), rng.randrange(3, 90), 1.0) for _ in range(120)] + [(rng.randrange(3, 90), rng.randrange(3, 90), 1.0) for _ in range(25)]
    yield "star", [(0, i, 1.0) for i in range(1, 40)]
    yield "two hubs alike", [(h, i, 1.0) for h in (0, 50) for i in range(1, 25)]
    yield "odd", [(1, 1, 1.0), (None, 2, 1.0), (3, 4, 1.0), (4, 3, 2.0), (3, 4, 1.0)]


@pytest.mark.parametrize("edges", [pytest.param(e, id=name) for name, e in graphs()])
def test_best_partners(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    for n in (1, 3):
        got = {(r.name, r.partner, r.position): round(r.affinity, 6) for r in partners.best_partners(df, n).collect()}
        assert got == best(edges, n)


def test_affinity_of_pairs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 9))) for _ in range(50)]
    documents = [(rng.randrange(35), rng.randrange(6)) for _ in range(60)] + [(None, 1), (2, None)]
    want = plain(edges, documents)
    e, m = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(documents, "name long, doc long")
    asked = spark.createDataFrame([(a, b) for a in range(36) for b in range(36)] + [(None, 1)], "src long, dst long")
    got = {(r.src, r.dst): (r.adamic_adar, r.shared, r.affinity) for r in partners.affinity_of(asked, e, m).collect()}
    assert len(got) == 36 * 35 // 2
    for pair, values in got.items():
        assert values == pytest.approx(want.get(pair, (0.0, 0.0, 0.0)))
    # the operator that scores all pairs agrees; a pair without an edge has no part of one
    whole = {(r.src, r.dst): r.affinity for r in graph.affinity(e, m).collect()}
    assert whole == pytest.approx({p: v[2] for p, v in want.items() if v[2] > 0})
    assert min(whole.values()) < 0.3


def test_empty(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert partners.best_partners(none, 3).count() == 0
    assert partners.affinity_of(none.select("src", "dst"), none).count() == 0


def test_star_makes_rows_in_proportion(spark):
    """Ten times the leaves make ten times the candidates, not a hundred times."""
    size = 20_000
    star = spark.range(1, size).selectExpr("0L AS src", "id AS dst", "1.0D AS weight")
    rows = partners.best_partners(star, 2).where("name != 0")
    assert rows.count() == 2 * (size - 1)


def test_affinity_shuffles_no_pairs(spark):
    """Pairs are made (Generate) below all that sums them up, and no exchange lies between; they agree with plain Python across blocks."""
    rng = random.Random(11)
    edges = [(rng.randrange(700), rng.randrange(700), 1.0) for _ in range(900)]
    documents = [(rng.randrange(700), rng.randrange(9)) for _ in range(900)]
    e, m = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(documents, "name long, doc long")
    d = graph.affinity(e, m)
    above = d._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Exchange" not in above and "Join" not in above
    got = {(r.src, r.dst): r.affinity for r in d.collect()}
    assert got == pytest.approx({p: v[2] for p, v in plain(edges, documents).items() if v[2] > 0})


def test_partners_that_tie_at_a_limit(spark):
    """An edge of weight 3 and many common neighbours both give 0.6; as numbers they differ in the last bit, and names decide."""
    edges = [(h, i, 1.0) for h in range(100, 108) for i in range(3)] + [(0, 9, 3.0)]
    got = {(r.name, r.partner, r.position): round(r.affinity, 6) for r in partners.best_partners(spark.createDataFrame(edges, "src long, dst long, weight double"), 2).collect()}
    assert got == best(edges, 2)
    assert {(0, 1, 1), (0, 2, 2)} <= set(got)


def test_partners_leave_few_pairs_to_score(spark, monkeypatch):
    """In a dense graph whose scores are alike, what is scored once more is less than half of all pairs."""
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120), 1.0) for _ in range(2_000)]
    asked, score = [], partners.affinity_of
    monkeypatch.setattr(partners, "affinity_of", lambda pairs, *a: asked.append(pairs.count()) or score(pairs, *a))
    got = {(r.name, r.partner, r.position): round(r.affinity, 6) for r in partners.best_partners(spark.createDataFrame(edges, "src long, dst long, weight double"), 3).collect()}
    assert got == best(edges, 3)
    assert asked[0] <= 120 * 119 // 2


@pytest.mark.parametrize("edges", [pytest.param(e, id=name) for name, e in graphs()])
def test_best_partners_beside_hubs_in_parts(spark, monkeypatch, edges):
    """With hubs from four links on, blocks of few wedges, names in several parts and lists in several rows, rows are the same."""
    for name, value in (("HUB", 2), ("WEDGES", 40), ("LIST", 8)):
        monkeypatch.setattr(partners, name, value)
    monkeypatch.setattr(wedges, "BATCH", 25)
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    for n in (1, 3):
        got = {(r.name, r.partner, r.position): round(r.affinity, 6) for r in partners.best_partners(df, n).collect()}
        assert got == best(edges, n)


def test_partners_of_names_without_weights(spark):
    """Names are strings, edges without a weight still make neighbours, and sums are those of all common neighbours."""
    edges = [("b", "a", None), ("c", "a", 2.0), ("c", "b", None), ("b", "c", 1.0), ("d", "a", 1.0), (None, "a", 1.0)]
    got = {(r.name, r.partner): (r.adamic_adar, r.affinity, r.position) for r in partners.best_partners(spark.createDataFrame(edges, "src string, dst string, weight double"), 2).collect()}
    assert got["b", "c"] == pytest.approx((1 / math.log(3), 0.4, 1)) and got["b", "a"] == pytest.approx((1 / math.log(2), 1 / math.log(2) / 5, 2))
    assert got["a", "c"] == pytest.approx((1 / math.log(2), 0.5, 1)) and got["d", "b"] == pytest.approx((1 / math.log(3), 1 / math.log(3) / 5, 2))
    assert len(got) == 8


def test_partners_shuffle_lists_and_no_pairs(spark):
    """In a dense graph of 9,000 edges, whose pairs and wedges are many more, few rows for each edge are shuffled in all."""
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300), 1.0) for _ in range(9_000)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    before = {(s.stageId(), s.attemptId()) for s in map(stages().apply, range(stages().size()))}
    assert partners.best_partners(df, 3).count() == 900
    found = stages()
    rows = sum(s.shuffleWriteRecords() for s in map(found.apply, range(found.size())) if (s.stageId(), s.attemptId()) not in before)
    assert 9_000 < rows < 10 * 9_000


@pytest.mark.parametrize("value", [("DENSE", 0), ("DENSE", 10**9), ("PRODUCT", 0), ("AT_ONCE", 2), ("BATCH", 10)])
def test_affinity_in_small_cells(spark, monkeypatch, value):
    """Cells of few pairs and of many, by products or one by one, in small batches, give the same rows, edges of no worth too."""
    monkeypatch.setattr(cells, "BLOCK", 16)
    monkeypatch.setattr(cells, *value)
    rng = random.Random(13)
    edges = [(rng.randrange(90), rng.randrange(90), float(rng.randrange(1, 5))) for _ in range(120)] + [(90, 91, -9.0)]
    documents = [(rng.randrange(99), rng.randrange(40) // 5) for _ in range(120)] + [(rng.randrange(99), 50 + i) for i in range(60)]
    e, m = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(documents, "name long, doc long")
    for docs in ((), documents):
        rows = graph.affinity(e, m if docs else None).collect()
        got = {(r.src, r.dst): (r.adamic_adar, r.shared, r.affinity) for r in rows}
        want = {p: v for p, v in plain(edges, docs).items() if v[0] > 0 or v[1] > 0 or v[2] > 0 or p == (90, 91)}
        want[90, 91] = (*want[90, 91][:2], max(want[90, 91][2], 0.0))
        assert len(rows) == len(got) and set(got) == set(want)
        for pair, values in got.items():
            assert values == pytest.approx(want[pair])


def test_affinity_of_a_document_of_all(spark):
    """A document of all names is dealt out to cells as lists: a million pairs come from few rows."""
    names = spark.range(1_500).selectExpr("id AS name", "explode(array('x', 'y')) AS doc")
    d = graph.affinity(spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double"), names)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    before = {(s.stageId(), s.attemptId()) for s in map(stages().apply, range(stages().size()))}
    assert d.where("shared = 1 AND affinity BETWEEN 0.69 AND 0.71").count() == 1_500 * 1_499 // 2
    found = stages()
    assert sum(s.shuffleWriteRecords() for s in map(found.apply, range(found.size())) if (s.stageId(), s.attemptId()) not in before) < 1_000
