"""Louvain as joins against plain Python; its invariants on odd graphs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from docloom.operators import communities, graph

EDGES = "src long, dst long, weight double"


def plain_modularity(edges, of) -> float:
    total = 2 * sum(w for _, _, w in edges)
    inside, degrees = 0.0, defaultdict(float)
    for a, b, w in edges:
        degrees[of[a]] += w
        degrees[of[b]] += w
        inside += 2 * w * (of[a] == of[b])
    return inside / total - sum((d / total) ** 2 for d in degrees.values())


def plain_louvain(edges) -> dict:
    """One node after another, in order, until nothing gains; then the same with communities as nodes."""
    names = {n for a, b, _ in edges for n in (a, b)}
    of = {n: n for n in names}
    while True:
        near, degree = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in edges:
            a, b = of[a], of[b]
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        total, place, sums = sum(degree.values()), {n: n for n in degree}, dict(degree)
        any_move, moved = False, True
        while moved:
            moved = False
            for n in sorted(degree):
                to = defaultdict(float)
                for m, w in near[n].items():
                    to[place[m]] += w
                sums[place[n]] -= degree[n]
                best = max([place[n], *to], key=lambda c: (round(to[c] - degree[n] * sums[c] / total, 12), c == place[n], -c))
                sums[best] += degree[n]
                if best != place[n]:
                    place[n], moved, any_move = best, True, True
        if not any_move:
            return of
        of = {n: place[c] for n, c in of.items()}


def random_graph(rng, groups, size, inside, outside):
    n = groups * size
    return [(a, b, float(rng.randrange(1, 4))) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else outside)]


@pytest.mark.parametrize("seed, groups, size, inside, outside", [(1, 6, 20, 0.5, 0.01), (2, 4, 30, 0.3, 0.04)])
def test_louvain_agrees_with_plain_python(spark, seed, groups, size, inside, outside):
    edges = random_graph(random.Random(seed), groups, size, inside, outside)
    d = spark.createDataFrame(edges, EDGES)
    rows = communities.louvain(d)
    of = {r.node: r.community for r in rows.collect()}
    reached = plain_modularity(edges, of)
    assert abs(communities.modularity(d, rows).first()[0] - reached) < 1e-9
    assert reached >= 0.97 * plain_modularity(edges, plain_louvain(edges))
    spread = {r.node: r.community for r in graph.label_propagation(d).collect()}
    assert reached >= plain_modularity(edges, spread) - 1e-9
    assert all(c == min(n for n in of if of[n] == c) for c in of.values())
    if seed == 1:
        assert len({(n // size, c) for n, c in of.items()}) == groups  # the planted groups
        again = {r.node: r.community for r in communities.louvain(d.repartition(7)).collect()}
        assert again == of


def test_louvain_on_odd_graphs(spark):
    nodes = spark.createDataFrame([(1,), (2,), (9,), (9,), (None,)], "node long")
    none = spark.createDataFrame([], EDGES)
    assert sorted(map(tuple, communities.louvain(none, nodes).collect())) == [(1, 1), (2, 2), (9, 9)]
    assert communities.louvain(none).count() == 0 and communities.modularity(none, nodes.selectExpr("node", "node AS community")).first()[0] is None
    two = [(1, 2, 5.0), (2, 1, 1.0), (2, 3, 2.0), (3, 1, 2.0), (3, 4, 0.5), (4, 5, 2.0), (5, 6, 2.0), (6, 4, 2.0), (7, 7, 1.0), (None, 1, 1.0), (8, 1, None), (8, 1, 0.0)]
    of = {r.node: r.community for r in communities.louvain(spark.createDataFrame(two, EDGES), nodes).collect()}
    assert of == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 9: 9}
    ring = [(i, (i + 1) % 16, 1.0) for i in range(16)]  # every node alike: moves all at once would swap
    found = {r.node: r.community for r in communities.louvain(spark.createDataFrame(ring, EDGES)).collect()}
    assert plain_modularity(ring, found) >= 0.9 * plain_modularity(ring, plain_louvain(ring))
    star = [(0, i, 1.0) for i in range(1, 200)]
    assert {r.community for r in communities.louvain(spark.createDataFrame(star, EDGES)).collect()} == {0}
