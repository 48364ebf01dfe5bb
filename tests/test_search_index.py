"""An index kept up by batches finds what one built at once finds; batches again, merges, and what is written."""

from __future__ import annotations

import os
import random

from docloom.operators import search
from docloom.operators.search_index import SegmentIndex

KIND = "doc_id long, text string"


def rows_of(d):
    return [(r.doc_id, round(r["rank"], 9)) for r in d.collect()]


def test_index_kept_up_by_batches(spark, tmp_path):
    rng, path, now = random.Random(3), str(tmp_path / "index"), {}
    text = lambda: " ".join(rng.choice("alpha beta gamma delta eps".split()) + str(rng.choice(["", "", 1])) for _ in range(rng.randrange(1, 12)))
    folders = set()
    for batch in range(6):
        put = {rng.randrange(60): text() for _ in range(40 if batch == 0 else 6)}
        gone = rng.sample(range(70), 5) if batch else []
        gone = None if batch == 3 else gone
        now = {i: t for i, t in now.items() if i not in (gone or [])} | put
        d = spark.createDataFrame([*put.items(), (None, "alpha")], KIND)
        g = None if gone is None else spark.createDataFrame([(i,) for i in gone] + [(None,)], "doc_id long")
        index = SegmentIndex(spark, path)
        assert index.update(batch, d, g) and not SegmentIndex(spark, path).update(batch, d, g)
        whole = spark.createDataFrame(sorted(now.items()), KIND)
        for query in ("alpha", "Beta gamma", "delta1 alpha", "nowhere", "..."):
            assert rows_of(SegmentIndex(spark, path).search(query, 50)) == rows_of(search.bm25(whole, query, 50)), (batch, query)
        index = SegmentIndex(spark, path)
        assert index.totals["n_docs"] == len(now) and len(index._counting()) <= 4
        if batch == 0:
            folders = {f: os.stat(f"{path}/postings/{f}").st_mtime_ns for f in os.listdir(f"{path}/postings")}
        if batch == 2:  # small batches leave the large segment alone
            assert all(os.stat(f"{path}/postings/{f}").st_mtime_ns == t for f, t in folders.items())
    assert any(s["low"] < s["high"] for s in index._counting())  # some were merged


def test_index_without_documents(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "index"))
    assert index.search("alpha", 3).count() == 0
    d = spark.createDataFrame([(1, "alpha"), (1, "alpha beta"), (2, None)], KIND)
    assert index.update(4, d) and rows_of(index.search("beta", 3)) == rows_of(search.bm25(spark.createDataFrame([(1, "alpha beta"), (2, "")], KIND), "beta", 3))
    assert index.update(5, gone=d.select("doc_id")) and index.search("alpha", 3).count() == 0 and index.totals["n_docs"] == 0
    assert not index.update(2, d)


def test_terms_are_counted_within_rows_and_sorted_in_bounded_parts(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta", "ÄB", "x1", "法律"]) for _ in range(rng.randrange(0, 30)))) for i in range(50)] + [(50, None), (51, ""), (None, "beta"), (3, "zz beta"), (3, "alpha")]
    d = spark.createDataFrame(rows, KIND)
    kept = search.once(d)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == list(range(52)) and kept.where("doc_id IS NULL").count() == 1
    assert kept.where("doc_id = 3").first().text == max(t for i, t in rows if i == 3)
    counted = search.counted_terms(kept)
    assert sorted(map(tuple, search.postings_of(counted).collect()), key=str) == sorted(map(tuple, search.postings(kept).collect()), key=str)
    assert sorted(map(tuple, counted.select("doc_id", "n_tokens").collect()), key=str) == sorted(map(tuple, search.document_lengths(kept).collect()), key=str)
    single = search.counted_terms(d)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in single and "Exchange" not in single  # no task gathers the terms of many documents
    monkeypatch.setattr(search, "TASK_POSTINGS", 10)
    search.write_index(d, str(tmp_path / "i"))
    found = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert found.count() == search.postings(kept).count() and len(found.inputFiles()) > 8  # many small sorts, not one for each shuffle partition
