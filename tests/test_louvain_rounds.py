"""What a round of Louvain keeps: rows of nodes and communities, never of edges; broadcast or shuffled, the same moves."""

from __future__ import annotations

from docloom.operators import communities

EDGES = "src long, dst long, weight double"


def test_a_round_writes_rows_of_nodes_alone(spark, monkeypatch):
    d = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a in range(24) for b in range(a + 1, 24)], EDGES)
    folder, sizes, written = communities._Folder(spark), [], communities._Folder.written

    def counted(self, df):
        out = written(self, df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(communities._Folder, "written", counted)
    level = communities._Level(communities.undirected(d), 1.0, folder)
    assert sizes[0] == 24 * 23 and max(sizes[1:]) == 24
    few = sorted(level.moves().collect())
    monkeypatch.setattr(communities, "BROADCAST_ROWS", 0)
    assert few and sorted(communities._Level(communities.undirected(d), 1.0, folder).moves().collect()) == few
    state, before, n = level.state(), level.modularity, len(sizes)
    level.look(level.moved(level.moves()))
    assert max(sizes[n:]) == 24
    n = len(sizes)
    level.back_to(state)
    assert level.modularity == before and sorted(level.moves().collect()) == few and len(sizes) == n
