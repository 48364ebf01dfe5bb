"""Audit of filters that run one after another: what each removes in every order, by the multilinear extension of the
removal game (Owen, Management Science 1972)."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from fractions import Fraction
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import BLANK, checkpointed, words_of

#: Filters of the registered query, in the order of their bits; E, the copies, is not a matter of one text.
TEXT_FILTERS, COPIES = "ABCD", "E"
#: Orders grow with the factorial of the filters.
MOST_FILTERS = 7


def text_failures(text: Column, n_words: Column, n_different: Column) -> dict[str, Column]:
    """Failure conditions of one text (not null): few words, few different words, many capitals, symbols."""
    return {
        "A": n_words < 100,
        "B": 100 * n_different < 80 * n_words,
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_of(failures: Mapping[str, Column]) -> Column:
    """An int with bit i set where the i-th condition holds; a condition that is null does not hold."""
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())), F.lit(0))


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part (``lang``, null as empty), mask: a row for each row of ``docs`` (doc_id, text, lang), with the bits
    of A, B, C, D and E.

    Null texts are empty ones. E looks at the whole table: a text fails if a smaller id has it. A null id is neither
    smaller nor larger than another, so it never fails E; rows that repeat an id and its text are no copies of each
    other. Copies are found by digest with a minimum on the map side; the smallest ids then join by id and digest, so
    a text that a third of the rows share is never gathered.
    """
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", words_of(F.col("text"), BLANK))
    failures = text_failures(F.col("text"), F.size("words"), F.size(F.array_distinct("words")))
    own = checkpointed(d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask_of(failures).alias("mask")))
    first = own.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return own.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << len(TEXT_FILTERS)).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many rows of ``masks`` (doc_id, part, mask) there are, and how many of them
    ``labels`` (doc_id, quality, toxic) call good and toxic. Repeated labels of an id count once, any 1 holds."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    d = masks.join(known, "doc_id", "left")
    return d.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])


def _orders(names: str) -> str:
    """All orders of the filters as JSON, a struct for each step: its filter's bit, and the bits of those before it."""
    bit = {c: 1 << i for i, c in enumerate(names)}
    steps = [{"filter_order": "".join(o), "step": k + 1, "bit": bit[c], "before": sum(bit[x] for x in o[:k])} for o in permutations(names) for k, c in enumerate(o)]
    return json.dumps(steps)


def interaction_audit(counts: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of
    the filters ``names`` (a letter each, in the order of the mask's bits), zeros included.

    ``counts`` holds part, mask, n, good, toxic. With x_i the share at which filter i is applied, the expected number of
    removed documents is a multilinear polynomial: a document that fails the filters m is removed with 1 - prod(1 - x_i)
    over i in m. Its coefficients are signed sums of mask counts. At a corner the polynomial counts what a set of filters
    removes; the derivative by x_i at the corners zero and one counts what i fails and what it alone fails; and the
    integral of that derivative along the diagonal is the filter's Shapley value, here times the number of orders. Each
    monomial of degree d integrates to 1/d, so the sum is exact. A part's row holds 2^filters numbers, however many
    documents there are. No counts give no rows.
    """
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) != len(names):
        raise ValueError(f"between 1 and {MOST_FILTERS} different filters, not {names!r}")
    orders, full = math.factorial(len(names)), (1 << len(names)) - 1
    weights = [Fraction(orders, d) for d in range(1, len(names) + 1)]  # of a monomial of degree d
    assert all(w.denominator == 1 for w in weights)
    values = ("n", "good", "toxic")
    zero = F.lit(0).cast("long")

    def added(rows: Column, value) -> Column:
        return F.aggregate(rows, zero, lambda total, r: total + value(r))

    def coefficient(monomial: Column, value: str) -> Column:
        held = F.filter("masks", lambda m: m["mask"].bitwiseAND(monomial) == monomial)
        return added(held, lambda m: m[value]) * F.when(F.bit_count(monomial) % 2 == 1, 1).otherwise(-1)

    def at(corner: Column, value: str) -> Column:
        return added(F.filter("terms", lambda t: t["monomial"].bitwiseAND(corner) == t["monomial"]), lambda t: t[value])

    def derivative(bit: Column, corner: Column, value: str) -> Column:
        return at(corner.bitwiseOR(bit), value) - at(corner.bitwiseAND(F.bitwise_not(bit)), value)

    def integral(bit: Column) -> Column:
        whole = F.array(*[F.lit(w.numerator).cast("long") for w in weights])
        return added(F.filter("terms", lambda t: t["monomial"].bitwiseAND(bit) != 0), lambda t: t["n"] * F.get(whole, F.bit_count(t["monomial"]) - 1))

    parts = counts.groupBy("part").agg(F.sum("n").alias("documents"), F.collect_list(F.struct("mask", *values)).alias("masks"))
    terms = F.transform(F.sequence(F.lit(1), F.lit(full)), lambda s: F.struct(s.alias("monomial"), *[coefficient(s, v).alias(v) for v in values]))
    parts = parts.select("part", "documents", terms.alias("terms"))
    steps = F.from_json(F.lit(_orders(names)), "array<struct<filter_order string, step int, bit int, before int>>")
    d = parts.select("part", "documents", "terms", F.explode(steps).alias("o")).select("part", "documents", "terms", "o.*")
    removed = derivative(F.col("bit"), F.col("before"), "n")
    return d.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - at(F.col("before").bitwiseOR(F.col("bit")), "n")).alias("kept"),
        removed.alias("removed"),
        (derivative(F.col("bit"), F.lit(0), "n") - removed).alias("redundant"),
        derivative(F.col("bit"), F.lit(full), "n").alias("unique_fails"),
        *[derivative(F.col("bit"), F.col("before"), v).alias(f"{v}_lost") for v in ("good", "toxic")],
        integral(F.col("bit")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of A to E over ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, quality, toxic)."""
    counts = checkpointed(mask_counts(failure_masks(docs), labels))
    return interaction_audit(counts, TEXT_FILTERS + COPIES)


#: DuckDB SQL of the registered query: each order is played out on the masks' counts, without a polynomial.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
m AS (SELECT doc_id, part,
             CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
      FROM d JOIN firsts USING (text)),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before
      FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
