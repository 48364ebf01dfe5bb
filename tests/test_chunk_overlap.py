"""Overlaps of neighbouring chunks against plain Python; texts cut into overlapping pieces."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docloom.operators import chunking


def plain(before, after, least=6, most=500):
    top = min(len(before or ""), len(after or ""), most)
    return max((n for n in range(least, top + 1) if before[-n:] == after[:n]), default=0)


def test_overlap_length_against_plain_python(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("aab") for _ in range(n))
    rows = []
    for _ in range(300):
        common = word(rng.randrange(0, 20))
        rows.append((word(rng.randrange(0, 15)) + common, common + word(rng.randrange(0, 15))))
    rows += [("a" * 700, "a" * 600), ("x" + "ab" * 30 + "b", "ab" * 40), ("aaaaaaab" * 9, "aaaaaaaab"), ("金额😀" * 4, "金额😀" * 3 + "元"), ("", "abcdefg"), ("abcdefg", ""), (None, "abcdefg"), ("abcdefg", None)]
    d = spark.createDataFrame(rows, "a string, b string")
    got = d.select("a", "b", chunking.overlap_length(F.col("a"), F.col("b")).alias("n"), chunking.overlap_length(F.col("a"), F.col("b"), tries=1).alias("m")).collect()
    assert all(r.n == r.m == plain(r.a, r.b) for r in got)


def test_pieces_of_odd_texts(spark):
    texts = {1: "a\nb😀" * 100, 2: "", 3: None, 4: "x", 5: "y" * 60, 6: "z" * 61, 7: "金" * 100}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted((r.doc_id, r.piece, r.body) for r in chunking.pieces(d, "doc_id", "text", 60, 100).collect())
    assert got == sorted((k, p + 1, t[p : p + 100]) for k, t in texts.items() if t for p in range(0, len(t), 60))
    from docloom.plans import search_queries

    folder = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/odd"
    d.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    rows = search_queries.chunk_overlap(spark, folder).collect()  # an empty text was an error before
    assert len(rows) == len(got) and {r.overlap for r in rows if r.doc_id == 6} == {0} and max(r.overlap for r in rows) >= 40
