"""Vectors in blocks: the rows of a search over all, with most blocks unread where vectors fall into clusters."""

import numpy as np

from docloom.operators import vector_blocks, vectors


def table(spark, v):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


def same(spark, df, folder, query, k):
    found, report = vector_blocks.nearest_in_blocks(spark, folder, query, k)
    want = [(r.vec_id, round(r.score, 9)) for r in vectors.nearest(df, query, k).collect()]
    assert [(r.vec_id, round(r.score, 9)) for r in found.collect()] == want
    return report


def test_clusters(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    v = [*(centres[rng.integers(30)] + rng.normal(size=16) * 0.1 for _ in range(3000))]
    v += [v[5]] * 800 + [np.zeros(16), np.zeros(16), None]  # copies, vectors of zeros, none at all
    df = table(spark, v)
    folder = str(tmp_path / "index")
    vector_blocks.write_blocks(df, folder, blocks=40, sample=500)
    for query, k in ((v[0], 10), (v[5], 10), (v[5], 900), (rng.normal(size=16), 7)):
        report = same(spark, df, folder, [float(x) for x in query], k)
        assert report["rows"] == len(v) - 1
    few = same(spark, df, folder, [float(x) for x in v[0]], 10)
    assert few["blocks_read"] < few["blocks"] / 4 and few["rows_read"] < few["rows"] / 4
    every = same(spark, df, folder, [float(x) for x in v[0]], len(v) + 5)  # more than there are
    assert every["blocks_read"] == every["blocks"]
    same(spark, df, folder, [0.0] * 16, 5)


def test_no_structure(spark, tmp_path):
    """Where bounds cannot help, all blocks are read and the rows are right."""
    rng = np.random.default_rng(2)
    df = table(spark, rng.normal(size=(400, 32)))
    vector_blocks.write_blocks(df, str(tmp_path / "i"), blocks=16, sample=200)
    report = same(spark, df, str(tmp_path / "i"), rng.normal(size=32).tolist(), 5)
    assert report["blocks_read"] <= report["blocks"]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    vector_blocks.write_blocks(df, str(tmp_path / "e"))
    found, report = vector_blocks.nearest_in_blocks(spark, str(tmp_path / "e"), [1.0, 2.0], 3)
    assert found.count() == 0 and report == {"blocks": 0, "blocks_read": 0, "rows": 0, "rows_read": 0}
