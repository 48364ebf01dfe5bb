"""Training-data operators against SQL, brute force and round trips, on small and odd tables."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from docloom.llm import chat, components, decontaminate, language_id, length_histogram, license_scan, line_quality, packing, queries, simhash, token_store, url_filter
from docloom.llm.tokens import default_tokenizer

CLASHES = ["_id", "_hash", "words", "pos", "n_words", "host", "line", "component", "fp", "bin", "rank", "gone", "_key", "w", "s", "run", "wid", "pid", "rid"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, agrees):
    agrees(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle_on_odd_rows(name, spark, odd, tmp_path, agrees_on):
    agrees_on(queries.QUERIES[name], queries.ORACLES[name], odd, tmp_path)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, ties, and extra columns with names that operators use themselves."""
    rng = random.Random(1)
    words = ["the", "of", "Ärger", "stone", "x1", "naïve", "license", "日本"]
    long = " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(1_500))
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "a"),
        (4, "word", "de", None),
        (5, long, "en", "a"),
        (5, long, "en", "a"),
        (6, long.replace("stone1", "stone2", 3), "en", "b"),
        (None, "some text without an id, all rights reserved", "en", None),
        (None, None, None, None),
        (7, "All rights reserved. CC BY cc  by; General Public License\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "en", "a"),
        (7, "the same id again with another text", "en", "a"),
        (11, license_scan.TEMPLATES[22][1] + " and I love the MIT license.", "en", "a"),
        (8, "ABC def\x0bghi\x1cjkl mno ÀÉ <|endoftext|> 🙂", "fr", "a"),
        (9, "123 456 !!!", "fr", "a"),
        (10, "\n".join(f"common line number {i % 3} of the site" for i in range(30)), "en", "a"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASHES:
        d = d.withColumn(c, F.lit(f"clash {c}"))
    return d


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def agrees_on(spark):
    import duckdb
    from conftest import plain

    def check(query, sql, docs, folder) -> None:
        docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, "x1 naïve stone"), (1, "all rights"), (2, None), (3, ""), (None, "the stone"), (4, "common line number 1 of the site common line number 2 of the"), (4, "word"), (5, "word")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
        turns = [(1, 3, "user", "hi"), (1, 4, "assistant", "<|im_end|> x"), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (3, None, "user", "no number"), (3, 1, None, "b"), (3, 1, "user", None), (3, 1, "user", ""), (4, 5, "<|im_start|>", "x"), (4, 5, "user", "same turn"), (4, 6, "user", "on"), (6, 5, "user", "same turn"), (6, 5, "<|im_start|>", "x"), (7, 5, "user", "same turn"), (None, 1, "user", "lost"), (None, None, None, None), (8, 2, "user", None)]
        turns += [(9, i // 3, "user", f"turn {i} " + "long " * 2000) for i in range(150)] + [(10, 50 + i // 3, "user", f"turn {i} " + "long " * 2000) for i in range(90)]
        turns = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
        pages = [(1, "http://a.example.org/x#f", "<link rel='canonical' href='https://b.org/y'>"), (2, "https://b.org/y", "<META http-equiv=refresh content='0; url=/en/z'>"), (3, "https://b.org/en/z", '<link rel="canonical" href="https://x.net/es/1">'), (4, "https://www.example.com/en/5", "<link rel=canonical href=https://b.org/en/z>"), (5, None, None), (6, "no scheme", ""), (7, "HTTPS://LONE.org", None), (7, "HTTPS://LONE.org", None), (None, "http://x.net/es/", "x" * 100_000), (8, "", "<p>"), (9, "http://EXAMPLE.com/en/q?r#s", None), (10, "http:///en/", None)]
        pages = spark.createDataFrame(pages, "page_id long, url string, html string")
        for c in CLASHES:
            turns, pages = turns.withColumn(c, F.lit(1)), pages.withColumn(c, F.lit("clash"))
        turns.withColumn("cid", F.lit(5)).repartition(3).write.parquet(f"{folder}/conversations.parquet")
        pages.withColumn("node", F.lit(5)).repartition(2).write.parquet(f"{folder}/pages.parquet")
        labels = [(4, 1, 0), (5, 0, 1), (5, 1, 0), (None, 1, 1), (7, None, None), (10, 1, 1)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(5)).repartition(2).write.parquet(f"{folder}/labels.parquet")
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "pages", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        df = query(spark, str(folder))
        columns = sorted(df.columns)
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())

    return check


def union_find(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---- components


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    want = union_find(300, pairs)
    rows = [*pairs, (None, 1), (7, None), (5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {n: want[n] for p in pairs if p[0] != p[1] for n in p}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- 1


def test_urls(spark):
    rows = [
        (1, "http://a.example.org/x#f", "<html><link rel='canonical' href='https://b.org/y?a=1&amp;b=2'>"),
        (2, "https://b.org/y?a=1&b=2", "<META http-equiv=refresh content='0; url=/en/z'>"),
        (3, "https://b.org/en/z", '<link href="//www.q.example.com/en/1" rel="alternate canonical">'),
        (4, "https://www.example.com/en/5", "<link rel=canonical href=https://b.org/en/z>"),
        (5, None, None),
        (6, "no scheme", ""),
        (7, "HTTPS://LONE.org", None),
        (7, "HTTPS://LONE.org", None),
        (8, "http://x.net/es/", "<link rel=canonical href='mailto:x'>"),
        (9, "http://c.org/d/e", "<link rel=canonical href='rel/f'>"),
        (10, "http://c.org/d/rel/f", "<meta http-equiv=\"Refresh\" content=\"5;URL='http://x.net/fr/1'\">"),
        (11, "http://moved.org/", "<p>"),
        (12, "http://com/", "<p>"),
        (13, "http://notcom/", "<p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("node", F.lit(1))
    moved = spark.createDataFrame([("http://moved.org/#x", "http://target.example.com/en/1")], "from_url string, to_url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, url_filter.RULES, moved).collect()}
    assert got[1] == ("a.example.org", "/x", None, "block")
    assert [got[i][3] for i in (2, 3, 9, 10, 11)] == ["block"] * 5
    assert got[4] == ("www.example.com", "/en/5", "www.example.com/en/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("lone.org", "", None, "allow")
    assert got[8] == ("x.net", "/es/", "net/es/", "block")
    assert got[12][2:] == ("com/", "allow") and got[13][2:] == (None, "allow")
    assert url_filter.url_verdicts(pages.limit(0), url_filter.RULES).count() == 0


# ---- tokens, 2, 9, 10


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    return np.array(library().encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


ODD_TEXTS = ["", None, " a", "a ", "a  b", "a\n\nb", "a\n\n\nb c", "\n", " ", "a\r\nb", "don't stop's  now", "<|endoftext|> hi", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>\nb  <|endoftext|>", "<|endoftext|", "a \n b", "日本 語\n字", "a\tb c\t d", "\n\na b", "a b\n", "🙂 🙂\n🙂", "a\x1c b", "é" * 100 + " b", "a. b.. c!?", "x\n \ty"]


def test_encoder(monkeypatch):
    from docloom.llm import tokens

    monkeypatch.setattr(tokens, "GROUP_CHARS", 40)
    e = tokens.Encoder(default_tokenizer(), 50)
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice("ab .\n,é\t1'") for _ in range(60)) for _ in range(300)]
    for _ in range(2):
        assert e.encode(texts) == [ids_of(t) for t in texts]
    e.added_plain = False  # added tokens that look at what stands beside them
    assert e.encode(texts) == [ids_of(t) for t in texts]


def check_packing(docs, pieces, window):
    rows = pieces.collect()
    want = Counter(ids_of(r.text) + np.array([1], "<u4").tobytes() for r in docs.select("text").collect())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_seq[r.sequence_id].append(r)
    left = Counter()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        data = ids_of(r.text) + np.array([1], "<u4").tobytes()
        texts[(r.doc_id, len(data) // 4)].append(data)
    assert set(texts) == set(by_doc)
    for key, own in by_doc.items():
        spans = Counter((p.start, p.length) for p in own)
        assert sum(n * k[1] for k, n in spans.items()) == key[1] * len(texts[key])
        for p in own:
            assert p.ids_crc32 in {zlib.crc32(t[4 * p.start : 4 * (p.start + p.length)]) for t in texts[key]}
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_seq), sum(r.length for r in rows), left, want


def test_packing(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n, total, *_ = check_packing(docs, packing.pack(docs), 2048)
    assert total / (n * 2048) > 0.97
    check_packing(odd, packing.pack(odd), 2048)
    # a small window of lengths that do not pair, so that most pieces are left over and cut
    odd_lengths = spark.createDataFrame([(i, "word " * 150) for i in range(40)], "doc_id long, text string")
    n, total, *_ = check_packing(odd_lengths, packing.pack(odd_lengths, window=256), 256)
    assert total / (n * 256) > 0.9
    assert packing.pack(empty).count() == 0


def test_packing_parts():
    assert packing.combinations_filling(4) == [(4,), (1, 3), (1, 1, 2), (2, 2)]
    a = np.random.default_rng(0).random((20, 8))
    x = np.maximum(np.random.default_rng(1).normal(size=8), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = np.random.default_rng(2).normal(size=20)
    y = packing.nnls(a, b)
    gradient = a.T @ (b - a @ y)
    assert (y >= 0).all() and (gradient <= 1e-6).all() and abs(gradient[y > 1e-9]).max(initial=0) < 1e-5  # the KKT conditions
    used = Counter()
    histogram = {1: 7, 2: 5, 3: 9, 4: 2}
    for t, k in packing.plan(histogram, 4):
        for v in t:
            used[v] += k
    assert all(used[v] <= histogram[v] for v in used)
    parts = [b"abc", b"", b"defgh", b"\0\0"]
    assert packing.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_token_store(spark, odd, empty, tmp_path):
    for name, docs in (("docs", spark.read.parquet(f"{SMALL}/documents.parquet").limit(150)), ("odd", odd), ("empty", empty)):
        out = token_store.write_token_store(docs, str(tmp_path / name))
        got = sorted(token_store.read_token_store(spark, out).collect(), key=lambda r: r.start)
        rows = docs.select("doc_id", "text").collect()
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x or 0))
        assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((r.doc_id, ids_of(r.text) + b"\0\0\0\0") for r in rows)
        at = 0
        for r in got:
            assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
            at += r.n_tokens
    some = token_store.read_token_store(spark, str(tmp_path / "odd"), [5, 8]).collect()
    assert sorted(r.doc_id for r in some) == [5, 5, 8]


def test_length_histogram(spark, odd, empty):
    lengths = [len(ids_of(r.text)) // 4 for r in odd.select("text").collect()]
    assert Counter(r.n_tokens for r in length_histogram.token_lengths(odd).collect()) == Counter(lengths)
    lengths += [5, 5000, 1024, 1023, 1025]
    rows = length_histogram.length_histogram(spark.createDataFrame([(n,) for n in [*lengths, None]], "n_tokens long")).collect()
    assert sorted(r.length for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.docs_to == sum(n <= r.length for n in lengths) and r.docs_over == sum(n > r.length for n in lengths)
        assert r.tokens_to == sum(n for n in lengths if n <= r.length)
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths) and r.lost_tokens == sum(lengths) - r.truncated_tokens
        assert abs(r.quantile - r.docs_to / len(lengths)) < 1e-12
    assert length_histogram.length_histogram(length_histogram.token_lengths(empty)).count() == 0


# ---- 3


def test_boilerplate(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    line = " ".join(f"link{i}" for i in range(70))
    rows = [(i, f"{line}\n{prose(80)}", "big") for i in range(60)]  # boilerplate and text: stays
    rows += [(100 + i, f"{line}\n{prose(3)}", "big") for i in range(5)]  # hardly more than boilerplate: goes
    rows += [(200 + i, prose(80), "big") for i in range(20)] + [(300 + i, rows[0][1], "big") for i in range(40)]  # copies count once
    rows += [(400, f"{line}\nx", "small"), (401, f"{line}\ny", "small")]  # rare on its own host: stays
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_quality.line_quality(docs).collect()}
    gone = {k for k, r in got.items() if not r.kept}
    assert gone <= set(range(100, 105)) and len(gone) >= 4  # one may own the line
    assert got[400].kept and got[401].kept and not any(r.base_failed for r in got.values())
    kept = line_quality.without_rejects(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - gone


def test_boilerplate_on_a_host_far_larger_than_the_limit(spark):
    rows = [(i, f"own words of {i} " * 20 + "\nthe very same line", "big") for i in range(25)]
    rows += [(100 + i, f"nothing shared {i} " * 20, "big") for i in range(4000)]
    got = line_quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 100").collect()
    assert sum(r.left_words == r.n_words - 4 for r in got) == 24 and sum(r.left_words == r.n_words for r in got) == 1


def repeated(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)})


@pytest.mark.parametrize("spare", [0, 50])
def test_repeated_words_are_exact(spark, monkeypatch, spare):
    monkeypatch.setattr(line_quality, "SPARE", spare)  # at 50, hashes of a few bits collide all the time
    rng = random.Random(23)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 200))) for _ in range(60)] + ["a b c a b c", "x", ""]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in line_quality.profiles(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [repeated(t) for t in texts]


def test_boilerplate_lines_leave_the_text(spark):
    import corpus_pipeline as p

    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    head, foot = " ".join(f"link{i}" for i in range(70)), "Terms of  Use"
    bodies = {i: f"{prose(40)}\n\n \n  {prose(40)}\r" for i in range(60)}
    texts = {i: f"{head}\n{b}\n{head.upper()}\nterms of use \n" for i, b in bodies.items()} | {99: f"{foot}\n{prose(80)}"}
    rows = [(i, t, "big", len(t)) for i, t in texts.items()] + [(0, texts[0], "small", len(texts[0]))]
    rows += [(200 + i, f"{head}\n{prose(2)}", "big", 1) for i in range(5)]  # hardly more than boilerplate: goes
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = p.apply_quality_rules(spark, docs, SMALL)
    assert got.schema == docs.schema
    owners, seen = 0, {(r.doc_id, r.source): r for r in got.collect()}
    assert len(seen) >= 62 and seen[0, "small"].text == texts[0]
    for i, b in bodies.items():
        r = seen[i, "big"]
        owners += head in r.text
        assert r.n_chars == len(r.text) and b in r.text
        assert r.text == f"{b}\n" or head in r.text or "terms of use" in r.text
    assert owners <= 1 and sum("terms of use" in r.text.lower() for (_, s), r in seen.items() if s == "big") == 1
    assert {k for k, r in seen.items() if k[0] >= 200} == {k for k, r in seen.items() if k[0] >= 200 and head in r.text}


def test_quality_on_odd_tables(odd, empty):
    assert line_quality.line_quality(empty).count() == 0
    kept = line_quality.without_rejects(odd)
    assert kept.columns == odd.columns
    want = [r.doc_id for r in line_quality.line_quality(odd).where("kept").collect()]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)


# ---- 4


def brute_hits(text, items, window=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    w, hit, ids = low(text), set(), set()
    for item, t in items:
        v = low(t)
        n = min(window, len(v))
        runs = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in runs:
                hit |= set(range(i, i + n))
                ids |= set() if item is None else {str(item)}
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination(spark, odd, most):
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(n))
    items = [(i, some(rng.randrange(1, 40))) for i in range(30)] + [(30, "one"), (31, ""), (32, None), (33, "One two Three"), (3, "another text of item three with more than ten words in it now"), (None, some(12)), (None, "two words")]
    rows = [(100, "two words and " + items[-2][1]), (101, items[-2][1])]
    for i in range(60):
        t = some(rng.randrange(0, 80))
        if i % 3 == 0:
            source = (items[rng.randrange(30)][1] or "").split()
            a = rng.randrange(max(1, len(source)))
            t += ", " + " ".join(source[a : a + rng.randrange(8, 14)]).upper() + "! " + some(5)
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, "one"), (62, "one"), (None, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    longs = [(i, t) for i, t in items if len((t or "").split()) >= 10]  # without short items
    got = decontaminate.contamination(docs, spark.createDataFrame(longs, table.schema), most_broadcast=most).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((i, *brute_hits(t, longs)) for i, t in rows)
    got = decontaminate.contamination(docs, table, most_broadcast=most).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((i, *brute_hits(t, items)) for i, t in rows)


def test_decontamination_of_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "x1 naïve the word"), (2, "word")], "item_id long, text string")
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.decontaminated(odd, items)
    assert kept.columns == odd.columns and 4 not in {r.doc_id for r in kept.collect()} and kept.count() == odd.count() - 1
    assert decontaminate.decontaminated(odd, items.limit(0)).count() == odd.count()


# ---- 5


def test_language_models_are_distributions(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("la casa de la gata", "es"), ("that hat and the bat", "en"), ("una mesa y dos sillas", "es")] * 5)], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.langs == ["en", "es"]
    known = sorted({int(c) for t in docs.collect() for c in language_id.symbols(t.text)})
    for context in ([116, 0, 0], [0, 0, 0], [104, 116, 0], [97, 116, 32], [122, 122, 122]):
        parts = [np.array(known, np.uint64), *(np.full(len(known), c, np.uint64) for c in context)]
        total = np.exp2(model.log2p(parts).astype(float)).sum(0)
        unseen = np.exp2(model.log2p([np.array([0x4E2D], np.uint64), *(np.array([c], np.uint64) for c in context)]).astype(float))[0]
        seen_by = [len({int(c) for t in docs.where(F.col("lang") == lang).collect() for c in language_id.symbols(t.text)}) for lang in model.langs]
        assert np.allclose(total + unseen * (language_id.ALPHABET - np.array(seen_by)) - unseen * (len(known) - np.array(seen_by)), 1, atol=1e-3)


def plain_kneser_ney(texts):
    """The recursion of interpolated Kneser-Ney with dictionaries, one symbol at a time; log2 of a gram's probability."""
    top = Counter()
    for t in texts:
        word = [0]
        for c in [*re.sub(r"[^a-z\u00e0-\u00ff]+", " ", t.lower()).strip(), " "] if t.strip() else []:
            c = 0 if c == " " else ord(c)
            back = [0, 0, 0]
            for i, x in enumerate(reversed(word[-3:])):
                back[i] = x
                if x == 0:
                    break
            top[(c, *back)] += 1
            word = [0] if c == 0 else [*word, c]
    counts = {4: top}
    for k in (3, 2, 1):
        counts[k] = Counter(g[:k] for g in counts[k + 1])
    tables = {}
    for k, own in counts.items():
        ones, twos = sum(n == 1 for n in own.values()), sum(n == 2 for n in own.values())
        total, types = Counter(), Counter()
        for g, n in own.items():
            total[g[1:]] += n
            types[g[1:]] += 1
        tables[k] = (own, min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5, total, types)

    def p(gram, k):
        if k == 0:
            return 1 / language_id.ALPHABET
        own, discount, total, types = tables[k]
        context, lower = gram[1:k], p(gram, k - 1)
        if not total[context]:
            return lower
        return max(own[gram[:k]] - discount, 0) / total[context] + discount * types[context] / total[context] * lower

    return lambda gram: np.log2(p(gram, 4))


def test_language_models_against_plain_recursion(spark):
    rng = random.Random(19)
    langs = {"en": "the cat sat on that mat and the rat ran at noon", "es": "la casa de la gata roja y un perro más allá", "xx": "ab"}
    rows = [(i, " ".join(rng.choices(w.split(), k=rng.randrange(1, 9))), lang) for i, (lang, w) in enumerate(list(langs.items()) * 30)]
    docs = spark.createDataFrame([*rows, *rows[:40], (5, None, "en"), (6, "no label", None)], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    used = [(r.lang, r.text) for r in language_id.sampled(docs).collect() if int(r.draw * (1 << 53)) % language_id.CALIBRATE]
    assert len(used) < len(rows) and Counter(used) <= Counter((x[2], x[1]) for x in rows)  # repeated rows count once
    grams = [tuple(int(p[i]) for p in language_id._grams(language_id.symbols("the casa zzz and más")) ) for i in range(20)]
    grams += [(rng.choice([0, *map(ord, "abetz")]), *rng.choice([(0, 0, 0), (97, 0, 0), (116, 97, 0), (122, 122, 122), (104, 116, 0), (97, 99, 0)])) for _ in range(60)]
    got = model.log2p([np.array([g[i] for g in grams], np.uint64) for i in range(4)])
    for j, lang in enumerate(model.langs):
        want = plain_kneser_ney([t for x, t in used if x == lang])
        assert np.allclose(got[:, j], [want(g) for g in grams], atol=1e-4), lang


def test_language_sample_is_bounded(spark):
    rows = [(1, f"text number {i} of one id", "en") for i in range(300)] + [(2, "again", "en")] * 200 + [(3, "una", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r.lang for r in language_id.sampled(docs, 40).collect())
    assert 20 <= got["en"] <= 40 and got["es"] == 1 and set(got) == {"en", "es"}


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) == 0
    model = language_id.learn(docs)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" and r.rejected for r in rows if r.doc_id in (1, 2, 3, 9))
    assert all(r.lang_pred in model.langs for r in rows if r.doc_id in (4, 5, 6, 7))
    kept = language_id.identified(docs.withColumn("_id", F.lit(1)))
    assert kept.count() == docs.count() and kept.columns == [*docs.columns, "_id"]
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.learn(empty)).collect()} == {"und"}
    # scores do not depend on what else is in a batch
    texts = [r.text for r in docs.limit(30).collect()]
    bits, n = model.cross_entropy(texts)
    alone = np.array([model.cross_entropy([t])[0][0] for t in texts])
    assert np.allclose(bits, alone) and (n > 0).all()


# ---- 6


def notice(label, at=0):
    return [body for x, body, _ in license_scan.TEMPLATES if x == label][at]


def test_licences(spark):
    mit, bsd = notice("mit").split(), notice("bsd").split()
    mit_edited = mit[:6] + ["fee"] + mit[7:20] + ["hereby", "new"] + mit[22:50] + mit[51:]  # words replaced and left out
    rows = [
        (1, "Licensed under CC BY-NC 4.0."),
        (2, "Foo (c) 2020. " + " ".join(mit).upper() + ". THE SOFTWARE IS PROVIDED"),
        (3, "granted permission hereby free charge person software copy"),  # the words in another order
        (4, "Released under the MIT License.\n" * 3),
        (5, "all rights reserved all rights reserved"),
        (6, None),
        (7, "He once read the MIT license over lunch"),
        (8, "I love the Mozilla Public License"),
        (9, "x " * 50 + " ".join(mit_edited)),
        (10, " ".join(bsd[:40])),  # half of the longer notice, all of the shorter
        (11, " ".join(bsd[:9])),
        (12, "permission is hereby granted free of charge to any person obtaining a copy of this software"),  # the phrase is not there
        (13, "Released under MIT license"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert got[1].base_labels == "cc-by" and got[1].labels == "cc-by,cc-by-nc" and got[1].score == 1.0
    assert [got[i].labels for i in (2, 3, 4, 7, 8, 9, 10, 11, 12, 13)] == ["mit", "", "mit", "", "", "mit", "bsd", "", "", "mit"]
    assert got[2].score == got[4].score == 1.0 and 0.9 < got[9].score < 1 and got[7].score == 0
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].labels, got[5].score) == (2, 0, 3, "reserved", 0.0)
    assert (got[6].n_words, got[6].n_base, got[6].first_word, got[6].labels) == (0, 0, None, "")
    own = spark.createDataFrame([("love", "i love the mozilla", "love"), ("never", "some words", "not in it")], "label string, body string, phrase string")
    assert {r.doc_id for r in license_scan.license_scan(docs, own).where("labels = 'love'").collect()} == {8}
    assert license_scan.license_scan(docs, own.limit(0)).where("labels != base_labels").count() == 0


def test_many_notices_in_one_text(spark):
    notices = [notice("mit"), notice("apache", 1), notice("gpl"), notice("cc-by-sa"), notice("isc")]
    rows = [(1, ". ".join(notices)), (2, "\n".join(f"{body} x{i}" for i, (_, body, _) in enumerate(license_scan.TEMPLATES)))]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache,cc-by,cc-by-sa,gpl,isc,mit" and got[1].score == 1.0
    assert set(got[2].labels.split(",")) == {label for label, *_ in license_scan.TEMPLATES}


# ---- 7


@pytest.mark.parametrize("dense", [512, 1])
def test_simhash(spark, odd, empty, dense):
    rng = random.Random(13)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for i in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 400))]
        for j in range(4):
            rows.append((1000 + 10 * i + j, " ".join(w)))
            if w:
                w[rng.randrange(len(w))] = "changed"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    groups = union_find(len(rows), [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)])
    least = {}
    for (doc, _), g in zip(rows, groups, strict=True):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    want = Counter((doc, int(f), least.get(g)) for (doc, _), f, g in zip(rows, fps, groups, strict=True))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, dense_bucket=dense).collect())
    assert got == want and len(set(groups)) < len(rows) - 60
    first = {}
    for (doc, t), g in zip(rows, groups, strict=True):
        first.setdefault(g, set()).add((doc is None, doc or 0, t))
    kept = [(r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.one_of_each(docs, dense_bucket=dense).collect()]
    assert len(kept) == len(set(kept)) == len(first)
    for own in first.values():  # one row of each group, with its smallest id
        (stays,) = own & set(kept)
        assert stays[:2] == min(x[:2] for x in own)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    assert simhash.one_of_each(odd).columns == odd.columns


def test_simhash_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "lone text one two three"), (None, "lone text one two three"), (3, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(docs).collect()) == [(0, "lone text one two three"), (3, "x")]


def test_simhash_keeps_unlike_texts_of_one_id(spark):
    a, b = "the first text has quite a few words in it", "another one is about something else and longer than that"
    rows = [(2, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == [(2, a, "x"), (5, b, "z")]


def test_fingerprint_by_hand():
    import xxhash

    text = "The cat sat on the MAT today"
    w = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == want and simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest("a b", 42)


def test_segments_cover_every_radius():
    for n in (10, 10**6, 10**10):
        s = simhash.segments(n, 4)
        assert sum(w for _, w, _ in s) == 64 and sum(t + 1 for *_, t in s) == 5


# ---- 8


def test_chat(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", None)]
    long = [("user" if i % 2 else "assistant", f"turn {i} <|im_end|>") for i in range(200)]
    convs = {
        1: base,
        2: base[:2],
        3: base,
        4: [("user", "hi"), ("assistant", "other")],
        5: long,
        6: long[:130],
        7: long[:64],
        8: [(None, "x")],
        9: [("user", "hi")],
    }
    rows = [(c, 10 + i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows += [(2, 10, "user", "hi"), (10, None, "user", "unnumbered")]  # a repeated row, a turn without a number
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    kept = {r.conv_id: (r.n_turns, r.copies) for r in chat.maximal_conversations(d).collect()}
    assert kept == {1: (3, 2), 4: (2, 1), 5: (200, 1), 8: (1, 1), 10: (1, 1)}
    parts = defaultdict(dict)
    for r in chat.rendered(d).collect():
        parts[r.conv_id][r.part] = r.text
    whole = "".join(parts[5][i] for i in range(len(parts[5])))
    assert len(parts[5]) == 4 and whole.count("<|im_start|>") == whole.count("<|im_end|>") == 200
    assert parts[1][0] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.rendered(d.limit(0)).count() == 0


def test_chat_with_many_turns_at_one_place(spark):
    texts = [f"t{i:05}" for i in range(5000)]
    rows = [(None, None, "user", t) for t in texts] + [(1, 7, "user", t) for t in texts[:1000]] + [(1, 8 + i, "user", f"later {i}") for i in range(100)]
    d = spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string").repartition(7)
    got = defaultdict(dict)
    for r in chat.rendered(d).collect():
        assert r.text.count("<|im_start|>") <= chat.BLOCK and r.part not in got[r.conv_id]
        got[r.conv_id][r.part] = r.text
    one = lambda t: f"<|im_start|>user\n{t}<|im_end|>\n"
    for c, parts in got.items():
        assert sorted(parts) == list(range(len(parts)))
        whole = "".join(parts[i] for i in range(len(parts)))
        tied = texts if c is None else texts[:1000]
        assert Counter(re.findall(r"(?s)<.im_start.>.*?<.im_end.>\n", whole)[: len(tied)]) == Counter(map(one, tied))
        assert c is None or whole.endswith("".join(one(f"later {i}") for i in range(100)))
    assert set(got) == {None, 1} and len(got[None]) == 79 and len(got[1]) == 18


# ---- pipeline


def test_pipeline_stages(spark, odd, empty):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "quality_rules", "near_duplicates", "decontamination", "packing"]
    lang = p.recognise_language(spark, docs, SMALL)
    want = {r.doc_id for r in language_id.language_id(docs).where("NOT rejected").collect()}
    assert {r.doc_id for r in lang.collect()} == want and lang.columns == docs.columns
    good = p.apply_quality_rules(spark, docs, SMALL)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in line_quality.line_quality(docs).where("kept").collect()}
    single = p.drop_near_duplicates(spark, docs, SMALL)
    assert Counter(r.doc_id for r in single.collect()) == Counter({r.component_id for r in simhash.near_duplicates(docs).collect()})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = p.drop_contaminated(spark, docs, SMALL)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if not brute_hits(r.text, items)[-1]}
    check_packing(clean, p.pack_sequences(spark, clean, SMALL), 2048)
    for stage in (p.recognise_language, p.apply_quality_rules, p.drop_near_duplicates, p.drop_contaminated):
        assert stage(spark, empty, SMALL).count() == 0 and stage(spark, odd, SMALL).columns == odd.columns


def test_pipeline_run(spark):
    import corpus_pipeline as p

    pieces = p.run(spark, SMALL).collect()
    assert pieces and len({r.doc_id for r in pieces}) < 200
