"""Periodic runs against brute force, toxicity against the plain likelihood and held-out labels, audits played out in order."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from docloom.llm import filter_audit, periodic_runs, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "word", "de"), (5, "a b " * 40, "en"), (5, "a b " * 40, "en"), (6, "a b " * 40, "fr"), (None, "a b " * 40, "fr"), (None, None, None), (7, "ABC $ def", ""), (8, "one two three four " * 5 + "five", "de"), (9, "x\x1cy " * 30, "es"), (10, " ".join(f"w{i}" for i in range(150)), "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("words", "mask", "digest", "part", "ranges", "runs", "n", "toxic", "draw", "tail", "g"):
        d = d.withColumn(c, F.lit(f"clash {c}"))
    return d.repartition(3)


def brute_runs(x: list) -> list[tuple[int, int, int]]:
    """start, length, period: every stretch in which words q apart are equal, tried word by word."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q) and not any(all(x[k] == x[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_lags(monkeypatch):
    rng = random.Random(3)
    for _ in range(400):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        x = [rng.randrange(k) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, n)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            x[rng.randrange(n)] = rng.choice([0, 9])
        monkeypatch.setattr(periodic_runs, "BLOCK_CELLS", rng.choice([1, 50, 300, 1 << 18]))
        w, cut = periodic_runs.word_numbers([str(v) for v in x]), rng.randrange(1, n + 2)
        assert sorted(periodic_runs.runs_of_lags(w, 1, cut) + periodic_runs.runs_of_lags(w, cut, n), key=lambda r: (r[0], r[2])) == brute_runs(x)


def brute_digests(doc_id, text) -> tuple:
    words = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(((-k, s, q) for s, k, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_query(spark, odd, tmp_path):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 3000")
    planted = [(1000 + i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(80))), "en") for i in range(200)]
    every = docs.union(odd.select("doc_id", "text", "lang")).union(spark.createDataFrame(planted, docs.schema))
    every.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).drop("n_words").collect()
    want = [brute_digests(r.doc_id, r.text) for r in every.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(r.n_runs > 0 for r in got) > 30


def test_runs_of_long_texts_are_dealt_by_lag(spark, odd):
    rng = random.Random(7)
    block = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = [(1, " ".join(["x", *block * 4, "y", *["z"] * 40])), (2, " ".join(f"w{i}" for i in range(400))), (3, "a b c"), (1, " ".join(["x", *block * 4, "y", *["z"] * 40]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    whole = periodic_runs.periodic_runs(d)
    dealt = periodic_runs.periodic_runs(d, cells=3000)
    assert sorted(map(str, whole.collect())) == sorted(map(str, dealt.collect()))
    assert [tuple(r) for r in whole.where("doc_id = 1").first().runs if r.period == 90] == [(1, 360, 90)]
    assert periodic_runs.periodic_runs(d.limit(0)).count() == 0


def test_runs_with_other_limits(spark):
    d = spark.createDataFrame([(1, "a b a b a b c")], "doc_id long, text string")
    found = periodic_runs.periodic_runs(d, min_words=4, min_exponent=3).first()
    assert [tuple(r) for r in found.runs] == [(0, 6, 2)] and found.collapsed == "a b c"
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(d, min_exponent=1)


# ---- toxicity


def test_noisy_or_gradient_and_instances():
    """The fit finds the one bad sentence of each document, and its likelihood is that of the formula."""
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for k in range(300):
        d = [rng.sample(plain, 5) for _ in range(6)]
        if k % 3 == 0:
            d[rng.randrange(6)].append(rng.choice(["vile", "nasty"]))
        docs.append(d)
        labels.append(int(k % 3 == 0))
    names = ["nasty", *plain, "vile"]
    model = toxicity.fit(names, [[[names.index(w) for w in s] for s in d] for d in docs], np.array(labels))
    for d, y in zip(docs, labels, strict=True):
        p = [1 / (1 + math.exp(-(model.bias + sum(map(model.of_word, s))))) for s in d]
        some = 1 - math.prod(1 - v for v in p)
        assert (some > 0.5) == (y == 1)
        assert y == 0 or {"vile", "nasty"} & set(d[int(np.argmax(p))])
        z = np.array([math.log(v / (1 - v)) for v in p])
        assert math.isclose(1 / (1 + math.exp(-toxicity._noisy_or(-np.logaddexp(0, z).sum()))), some, rel_tol=1e-6, abs_tol=1e-6)


def test_toxicity_on_held_out_labels(spark, odd):
    """Documents put together from few words, of which some make a sentence toxic; a third is never learned from."""
    rng = random.Random(4)
    plain, bad = [f"{a}{b}" for a in "bdfgklmn" for b in ("ane", "iro", "ulle", "este", "onda")], ["vile", "nastyish", "nastyful"]
    rows = []
    for i in range(3000):
        text = ". ".join(" ".join(rng.sample(plain, 6)) + (" " + rng.choice(bad) if i % 5 == 0 and j == i % 4 else "") for j in range(4))
        rows.append((i, text, int(i % 5 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = d.select("doc_id", "text", F.lit("x").alias("words")), d.select("doc_id", "toxic", F.lit(1).alias("quality"))
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(found[r[0]].held_out for r in held) and sum(r.held_out for r in found.values()) == len(held)
    assert np.mean([found[i].predicted == y for i, _, y in held]) > 0.99
    for i, text, y in held:
        if y:
            assert len(found[i].offending) == 1
            s = found[i].offending[0]
            assert any(b in text[s.start : s.start + s.length] for b in bad)
    turned = labels.withColumn("toxic", F.when(F.expr("crc32(binary(string(doc_id))) % 4 = 2"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(5), turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in found.items())  # labels of held-out rows play no part


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    for found in (toxicity.toxicity(odd, labels), toxicity.toxicity(odd, labels.limit(0))):
        rows = found.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert all(r.predicted == 0 and r.offending == [] for r in rows if r.doc_id in (1, 2, 3))
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_sentences():
    text = "One two. Three!\n\n... four"
    assert [text[a:b] for a, b, _ in toxicity.sentences(text)] == ["One two.", " Three!\n\n...", " four"]
    assert toxicity.sentences(None) == [] and toxicity.sentences("B a b.") == [(0, 6, ["b", "a"])]


# ---- filter audit


def brute_audit(docs: list[tuple], labels: dict) -> set[tuple]:
    least: dict = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        rows.append((lang or "", fails, labels.get(i, (0, 0))))
    out = set()
    for part in {r[0] for r in rows}:
        own, shapley, steps = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in own) - len(gone)
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), redundant, sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2][0] for r in gone), sum(r[2][1] for r in gone)))
        out |= {(*s, shapley[s[1][s[2] - 1]]) for s in steps}
    return out


def test_filter_audit_played_out(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").union(odd.select("doc_id", "text", "lang"))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").union(spark.createDataFrame([(5, 0, 1), (5, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"))
    known: dict = {}
    for r in labels.where("doc_id IS NOT NULL").collect():
        before = known.get(r.doc_id, (0, 0))
        known[r.doc_id] = (max(before[0], int(r.quality == 1)), max(before[1], int(r.toxic == 1)))
    got = [tuple(r) for r in filter_audit.filter_audit(docs, labels).collect()]
    assert set(got) == brute_audit([tuple(r) for r in docs.collect()], known) and len(got) == len(set(got))
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0


def test_filter_audit_sql_on_odd_rows(spark, odd, tmp_path):
    import duckdb

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 0, 1), (5, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op13_filter_audit(spark, str(tmp_path))
    rel = con.execute(filter_audit.ORACLE)
    names = [c[0] for c in rel.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(rel.fetchall())


def test_shapley_of_other_filters(spark):
    """Three filters: values add up to what all remove, times the orders; a filter that removes nothing has none."""
    counts = spark.createDataFrame([("x", 0, 5, 0, 0), ("x", 1, 2, 1, 0), ("x", 3, 7, 0, 2)], "part string, mask int, n long, good long, toxic long")
    rows = filter_audit.interaction_audit(counts, "PQR").collect()
    assert len(rows) == 18 and len(json.loads(filter_audit._orders("PQR"))) == 18
    value = {r.filter_order[r.step - 1]: r.shapley for r in rows}
    assert value == {"P": 6 * 2 + 3 * 7, "Q": 3 * 7, "R": 0} and sum(value.values()) == 6 * 9
    with pytest.raises(ValueError):
        filter_audit.interaction_audit(counts, "PP")
