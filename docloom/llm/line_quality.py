"""Quality rules: fixed rules within a text, and the frequency of its lines across the documents of its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import BLANK, checkpointed, on_key, row_key, small_or_shuffled, without, words_of

WORD = r"[^\x20\x09-\x0D]+"
#: Base rules: fewer words, or a larger share of words in repeated three-word windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: A line is boilerplate on a host if more distinct documents of it than this have the line, however large the host is.
LINE_DOCS = 20
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.1
#: Bits of a window's hash that are given up; tests raise it, so that hashes collide.
SPARE = 0


def _repeated_words(words: Column, n: Column) -> tuple:
    """Four steps (packed windows, those met again, positions, count) to how many words lie in a three-word window found
    twice or more.

    Window hashes are packed with their positions into longs, so that sorting brings equal windows together: the
    position takes as many low bits as it needs, the hash the rest. Neighbours of equal hash are then compared word by
    word. Where two differ, the windows themselves are sorted instead, so the count is exact.
    """
    bits = (F.length(F.bin(n)) + SPARE).cast("int")

    def window(i: Column) -> Column:
        return F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long"))

    def head(x: Column) -> Column:
        return F.call_function("shiftrightunsigned", x, bits)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))

    def again(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(head(x) == head(F.get(s, i - 1)), F.lit(False)) | F.coalesce(head(x) == head(F.get(s, i + 1)), F.lit(False)))

    def positions(t: Column) -> Column:
        def unlike(i: Column) -> Column:
            a, b = F.get(t, i - 1), F.get(t, i)
            differ = [F.get(words, place(a) + k) != F.get(words, place(b) + k) for k in range(3)]
            return (head(a) == head(b)) & (differ[0] | differ[1] | differ[2])

        collided = F.when(F.size(t) > 1, F.exists(F.sequence(F.lit(1), F.size(t) - 1), unlike)).otherwise(F.lit(False))
        whole = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("s"), i.alias("i"))))
        twice = F.filter(whole, lambda x, i: F.coalesce(x["s"] == F.get(whole, i - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get(whole, i + 1)["s"], F.lit(False)))
        return F.sort_array(F.when(collided, F.transform(twice, lambda x: x["i"])).otherwise(F.transform(t, place)))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return packed, again, positions, covered


def _text_number(text: Column) -> Column:
    """60 bits of the text's MD5, which tell distinct documents apart and order them."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def profiles(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row for each row of ``docs``, made in one scan and checkpointed; null texts count as empty.

    Key, doc_id, ``host`` (null: one of its own), ``number`` of the text, the five counts of whole texts, ``base_failed``,
    and of each line ``lines``, the hash of its normalised form (null for a line without a word), and ``line_words``.
    """
    has_word = r"[^\x20\x09-\x0D]"
    d = docs.select(*row_key(), F.col("doc_id"), F.coalesce(F.col(host), F.lit("\0")).alias("host"), F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words_of(F.col("t"), BLANK)).withColumn("n", F.size("w")).withColumn("own", F.split("t", "\n"))
    packed, again, positions, covered = _repeated_words(F.col("w"), F.col("n"))
    hashed = F.transform("own", lambda x: F.when(x.rlike(has_word), F.xxhash64(F.trim(F.regexp_replace(F.lower(x), BLANK, " ")))))
    worded = F.filter("own", lambda x: x.rlike(has_word))
    d = d.select(
        "_id",
        "_hash",
        "doc_id",
        "host",
        _text_number(F.col("t")).alias("number"),
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        worded.alias("worded"),
        hashed.alias("lines"),
        F.transform("own", lambda x: F.regexp_count(x, F.lit(WORD))).alias("line_words"),
        "w",
        "n",
        F.when(F.col("n") >= 3, packed).otherwise(F.array().cast("array<long>")).alias("packed"),
    )
    d = d.withColumn("n_dup_lines", (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long")).withColumn("twice", again(F.col("packed")))
    d = d.withColumn("at", positions(F.col("twice"))).withColumn("n_repeat_words", covered(F.col("at")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return checkpointed(d.select("_id", "_hash", "doc_id", "host", "number", *counts, failed.alias("base_failed"), "lines", "line_words"))


def boilerplate(profiled: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """(host, line, owner): lines in more distinct documents of a host than the limit allows, and the document that keeps them.

    Distinct documents are distinct texts: copies count once. The owner is the text with the smallest number.
    """
    pairs = profiled.select("host", "number", F.explode(F.array_distinct("lines")).alias("line")).where("line IS NOT NULL").distinct()
    return pairs.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("number").alias("owner")).where(F.col("n") > line_docs).select("host", "line", "owner")


def _gone_lines(profiled: DataFrame, line_docs: int) -> DataFrame:
    """_id, _hash, host, ``at`` (places of the row's boilerplate lines in order, from 0) and ``gone`` (their words).

    Rows without boilerplate have none; a row's places are no more than its lines.
    """
    common = small_or_shuffled(checkpointed(boilerplate(profiled, line_docs)))
    lines = profiled.select("_id", "_hash", "host", "number", "line_words", F.posexplode("lines").alias("at", "line")).where("line IS NOT NULL")
    lines = lines.select("_id", "_hash", "host", "number", "at", "line", F.get("line_words", F.col("at")).alias("words"))
    gone = lines.join(common, ["host", "line"]).where("number != owner").select("_id", "_hash", "host", "at", "words").distinct()
    return gone.groupBy("_id", "_hash", "host").agg(F.sort_array(F.collect_list("at")).alias("at"), F.sum("words").alias("gone"))


def _verdicts(profiled: DataFrame, gone: DataFrame, least_left: float) -> DataFrame:
    # one text under one id on two hosts: the host that leaves least decides
    gone = gone.groupBy("_id", "_hash").agg(F.max("gone").alias("gone")).alias("g")
    d = profiled.join(gone, on_key(profiled, gone), "left").select(profiled["*"], F.coalesce("gone", F.lit(0)).alias("gone"))
    left = F.col("n_words") - F.col("gone")
    kept = ~F.col("base_failed") & ~((F.col("gone") > 0) & (left < least_left * F.col("n_words")))
    return d.select("_id", "_hash", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", left.alias("left_words"), kept.alias("kept"))


def line_quality(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, left_words, kept.

    Boilerplate lines are removed from every document but the one that owns them on its host, so that what they say is
    not lost; ``left_words`` are the words that stay. ``kept`` is false if a base rule failed or if boilerplate was
    removed and less than ``least_left`` of the words is left.

    Null texts count as empty and so fail; rows with a null host form a host of their own; repeated rows get the same
    result each; ties need no order. Texts are read once. Line counts are grouped with map-side sums; a host or line that
    a third of the rows share is never gathered.
    """
    profiled = profiles(docs, host)
    return _verdicts(profiled, _gone_lines(profiled, line_docs), least_left)


def without_rejects(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that ``line_quality`` keeps, all columns as they came."""
    return without(docs, line_quality(docs, **limits).where(~F.col("kept")))


def _without_places(text: Column, at: Column) -> Column:
    """``text`` without the lines at the places ``at`` (sorted); the slices between them, so that the work is linear."""
    lines = F.split(text, "\n")

    def between(i: Column) -> Column:
        start = F.coalesce(F.get(at, i - 1), F.lit(-1)) + 1
        return F.slice(lines, start + 1, F.coalesce(F.get(at, i), F.size(lines)) - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), between)), "\n")


def cleaned(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The rows of ``docs`` that ``line_quality`` keeps, each text without its boilerplate lines; columns as they came.

    All other lines stay as they are and in order, and the owner of a line keeps it on its host. ``n_chars``, where there
    is such a column, is the new text's length in rows whose text changes.
    """
    mark = "_key"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    profiled = profiles(docs, host)
    gone = checkpointed(_gone_lines(profiled, line_docs))
    kept = without(docs, _verdicts(profiled, gone, least_left).where(~F.col("kept")))
    keyed = kept.withColumns({f"{mark}id": F.col("doc_id"), f"{mark}hash": F.xxhash64("text"), f"{mark}host": F.coalesce(F.col(host), F.lit("\0"))})
    places = small_or_shuffled(gone.select(*[F.col(c).alias(f"{mark}{n}") for c, n in (("_id", "gone_id"), ("_hash", "gone_hash"), ("host", "gone_host"), ("at", "at"))]))
    same = F.col(f"{mark}id").eqNullSafe(F.col(f"{mark}gone_id")) & (F.col(f"{mark}hash") == F.col(f"{mark}gone_hash")) & (F.col(f"{mark}host") == F.col(f"{mark}gone_host"))
    at = F.col(f"{mark}at")
    d = keyed.join(places, same, "left").withColumn("text", F.when(at.isNotNull(), _without_places(F.col("text"), at)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(at.isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL of the registered query.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM p),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(3) AS r(k) GROUP BY rid),
ln AS (SELECT rid, host, md5(t) AS id, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT rid, host, id, l, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS nl,
              len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lw GROUP BY rid),
freq AS (SELECT host, nl, count(DISTINCT id) AS n, min(substr(id, 1, 15)) AS owner FROM lw GROUP BY host, nl),
common AS (SELECT host, nl, owner FROM freq WHERE n > 20),
gone AS (SELECT rid, sum(words) AS n FROM lw JOIN common c USING (host, nl) WHERE substr(id, 1, 15) <> c.owner GROUP BY rid),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (gone > 0 AND n_words - gone < 0.1 * n_words) AS kept,
       CAST(n_words - gone AS BIGINT) AS left_words
FROM f
"""
