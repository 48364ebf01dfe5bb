"""Pairs of records: small ones are paired within their row, without a join of rows; large ones are spread over cells."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

from docloom.operators import graph


def plain(rows) -> dict:
    of: dict = {}
    for r, i in rows:
        if r is not None and i is not None:
            of.setdefault(r, set()).add(i)
    return {r: set(combinations(sorted(s), 2)) for r, s in of.items() if len(s) > 1}


def test_pairs_of_records_about_the_limit(spark):
    rng = random.Random(5)
    sizes = [1, 2, 7, graph.PART - 1, graph.PART, graph.PART + 1, 3 * graph.PART]
    rows = [(r, i - 5) for r, n in enumerate(sizes) for i in rng.sample(range(400), n)]
    rows += rows[::3] + [(90, 4)] * (2 * graph.PART) + [(91, 4), (91, 5)] * graph.PART + [(None, 1), (None, 2), (92, None), (92, 3)]
    rng.shuffle(rows)
    found = [(r.r, (r.src, r.dst)) for r in graph.paired(spark.createDataFrame(rows, "r long, i long"), "r", "i").collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(r, p) for r, pairs in plain(rows).items() for p in pairs}


def test_small_records_are_not_joined(spark, monkeypatch):
    """All rows of pairs come from the rows of records, in partitions that grow with them."""
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    d = graph.paired(spark.range(2000).selectExpr("id DIV 4 AS r", "id % 7 AS i"), "r", "i")
    assert d.where("src >= dst").isEmpty()
    used = d.selectExpr("spark_partition_id() AS p").distinct().count()
    assert used >= 15 and d.count() == sum(len(p) for p in plain([(k // 4, k % 7) for k in range(2000)]).values())


def test_guarded_relations_of_small_and_large_records(spark):
    rows = [(1, i) for i in range(graph.PART + 9)] + [(2, 3), (2, 4), (2, 4), (3, 4), (3, 3), (4, 900), (4, 3), (None, 1)]
    records = spark.createDataFrame(rows, "r long, i long")
    none = spark.createDataFrame([], "subject long, predicate string, object long")
    found = graph.guarded_relations(none, records, "r", "i").collect()
    assert sorted((r.subject, r.object) for r in found) == sorted(set().union(*plain(rows).values()))
    assert graph.guarded_relations(spark.createDataFrame([(7, "in", 8)], none.schema), records, "r", "i").collect() == [(7, "in", 8)]


def test_grouping_of_pairs_grows_with_them(spark, monkeypatch):
    """Pairs are grouped in partitions of about TASK_PAIRS, whatever the session's number, and counted by hashes before."""
    monkeypatch.setattr(graph, "TASK_PAIRS", 1000, raising=False)
    rows = [(k // 8, (k * k + 7 * (k // 8)) % 1999) for k in range(8000)]
    records = spark.createDataFrame(rows, "r long, i long")
    pairs = [p for found in plain(rows).values() for p in found]
    none = spark.createDataFrame([], "subject long, predicate string, object long")
    for d, a, b in ((graph.cooccurrence(records, "r", "i"), "src", "dst"), (graph.guarded_relations(none, records, "r", "i"), "subject", "object")):
        assert d.selectExpr("spark_partition_id() AS p").distinct().count() >= len(pairs) // 2000
        assert sorted((r[a], r[b]) for r in d.collect()) == sorted(set(pairs))
    assert {(r.src, r.dst): r.weight for r in graph.cooccurrence(records, "r", "i").collect()} == Counter(pairs)


def test_pairs_of_dense_hashes(spark, monkeypatch):
    """Records that share a hash with a large one, a large one of few items and records of other hashes are all paired."""
    monkeypatch.setattr(graph, "HASHES", 3, raising=False)
    monkeypatch.setattr(graph, "DENSE", 50, raising=False)
    monkeypatch.setattr(graph, "TASK_PAIRS", 500, raising=False)
    rng = random.Random(9)
    rows = [(r, rng.randrange(40)) for r in range(30) for _ in range(rng.randrange(9))] + [(50, k % 3) for k in range(4000)] + [(51, k) for k in range(5 * graph.PART)]
    rows += [(52, k % (2 * graph.PART)) for k in range(900)]
    rng.shuffle(rows)
    records = spark.createDataFrame(rows, "r long, i long").repartition(6)
    found = [(r.r, (r.src, r.dst)) for r in graph.paired(records, "r", "i").collect()]
    expected = [(r, p) for r, pairs in plain(rows).items() for p in pairs]
    assert sorted(found) == sorted(expected)
    assert {(r.src, r.dst): r.weight for r in graph.cooccurrence(records, "r", "i").collect()} == Counter(p for _, p in expected)
