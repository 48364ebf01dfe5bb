"""Scores, confidence labels and the fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.ordering import numbered

#: Weights of the four signals.
SIGNAL_WEIGHTS = {"vector": 3.0, "keyword": 2.0, "graph": 4.0, "affinity": 1.5}


def fuse(lists: list[DataFrame], key: str, k: int = 60, item: str | None = None) -> DataFrame:
    """Reciprocal rank fusion: (key, rrf_score). Each list has ``key`` and a 1-based ``rank``.

    With ``item``, that column comes along from the first list that has the key; within a list, from its last row of it.
    """
    parts = [x.select(key, (1.0 / (k + F.col("rank"))).alias("s"), F.lit(i).alias("list"), F.col("rank"), *([item] if item else [])) for i, x in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    won = [F.min_by(item, F.struct("list", -F.col("rank"))).alias(item)] if item else []
    return both.groupBy(key).agg(F.sum("s").alias("rrf_score"), *won)


def fuse_weighted(signals: DataFrame, key: str, top_k: int = 20, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted fusion of rows (signal, key, rank, score): the best keys with their score and each signal's own score."""
    weights = weights or SIGNAL_WEIGHTS
    weight = F.coalesce(*[F.when(F.col("signal") == s, w) for s, w in weights.items()], F.lit(1.0))
    own = [F.max(F.when(F.col("signal") == s, F.col("score"))).alias(f"{s}_score") for s in weights]
    return signals.groupBy(key).agg(F.sum(weight / (k + F.col("rank"))).alias("rrf_score"), *own).orderBy(F.desc(F.round("rrf_score", 12)), key).limit(top_k)


def rerank(rows: DataFrame, score: str, order: str, text: str) -> DataFrame:
    """``final_score``: 1.1 for recent, 1.1 for authoritative, 0.95 where the first 100 characters came earlier."""
    seen = F.row_number().over(Window.partitionBy(F.substring(text, 1, 100)).orderBy(order)) > 1
    return rows.withColumn("final_score", F.col(score) * F.when(F.col("recent"), 1.1).otherwise(1.0) * F.when(F.col("authoritative"), 1.1).otherwise(1.0) * F.when(seen, 0.95).otherwise(1.0))


def overlap_ratio(merged: Column, inputs: Column) -> Column:
    return F.when(inputs > 0, 1 - merged / inputs).otherwise(0.0)


def confidence(similarity: Column, keyword: Column, exact: Column | None = None, structured: Column | None = None, source: Column | None = None) -> Column:
    """EXTRACTED, INFERRED or AMBIGUOUS."""
    no = F.lit(False)
    return (
        F.when(F.coalesce(exact if exact is not None else no, no), "EXTRACTED")
        .when(F.coalesce(structured if structured is not None else no, no), "EXTRACTED")
        .when(F.coalesce(source == "graph" if source is not None else no, no), "EXTRACTED")
        .when(similarity > 0.7, "EXTRACTED")
        .when((similarity > 0.5) | (keyword > 0.6), "INFERRED")
        .when((similarity > 0.3) | (keyword > 0.3), "INFERRED")
        .otherwise("AMBIGUOUS")
    )


def confidence_level(label: Column) -> Column:
    """3, 2, 1 for the three labels in any case; anything else counts as AMBIGUOUS."""
    return F.when(F.upper(label) == "EXTRACTED", 3).when(F.upper(label) == "INFERRED", 2).otherwise(1)


def at_least(rows: DataFrame, label: str, least: str) -> DataFrame:
    order = {"EXTRACTED": 3, "INFERRED": 2, "AMBIGUOUS": 1}
    return rows.where(confidence_level(F.col(label)) >= order.get(least.upper(), 1))


def confidence_counts(rows: DataFrame, label: str, group: str | None = None) -> DataFrame:
    level = confidence_level(F.col(label))
    aggregates = [F.count_if(level == n).alias(name) for name, n in (("extracted", 3), ("inferred", 2), ("ambiguous", 1))]
    return rows.groupBy(group).agg(*aggregates) if group else rows.agg(*aggregates)


def fusion_metrics(lists: list[DataFrame], key: str) -> DataFrame:
    """One row: inputs, merged (different keys) and overlap_ratio of ranked lists."""
    both = lists[0].select(key)
    for x in lists[1:]:
        both = both.union(x.select(key))
    n = both.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inputs"), F.count("*").alias("merged"))
    return n.select("inputs", "merged", overlap_ratio(F.col("merged"), F.col("inputs")).alias("overlap_ratio"))


def score_confidence(score: Column) -> Column:
    """The label of a hit by its score alone."""
    return F.when(score > 0.7, "EXTRACTED").when(score > 0.3, "INFERRED").otherwise("AMBIGUOUS")


def source_layer(chunk_id: Column) -> Column:
    return F.when(chunk_id.startswith("l0_"), "L0").when(chunk_id.startswith("l1_"), "L1").when(chunk_id.startswith("l2_") | chunk_id.contains("_"), "L2").otherwise("unknown")


def relevance(layer: str, raw: Column) -> Column:
    """Scores of a layer on one scale: logistic for matches (L0) and ranks (L1), cut to 0..1 for similarities (L2)."""
    if layer == "L0":
        return 1 / (1 + F.exp(-(raw - 2)))
    if layer == "L1":
        return 1 / (1 + F.exp(-((raw + 10) / 3.5)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def drill_down(score: Column, threshold: float = 0.4) -> Column:
    return score < threshold


def progressive(levels: list[tuple[str, DataFrame]], threshold: float = 0.4) -> DataFrame:
    """The rows of the first level, in the order given, whose best relevance reaches the threshold; else of the last."""
    for i, (_, rows) in enumerate(levels):
        best = rows.agg(F.max("relevance")).first()[0]
        if i + 1 == len(levels) or (best is not None and best >= threshold):
            return rows
    raise ValueError("no levels")


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in a given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def top_of_each(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; partial limits before the shuffle keep a hot group small."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= n)


def two_stage(entity_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Keyword hits (doc_id, seq) ordered by what entity hits (doc_id, score) give their documents, then as they came."""
    boost = entity_hits.groupBy(F.col("doc_id").alias("_d")).agg(F.sum("score").alias("boost"))
    d = keyword_hits.join(boost, F.col("doc_id") == F.col("_d"), "left").drop("_d").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return numbered(d, [], [F.desc("boost"), F.col("seq")], "position")


def evidence(hits: DataFrame, doc: str, order: list[Column], per_doc: int = 3, docs: int = 5) -> DataFrame:
    """The best hits of each of the best documents, by their best hit: ``per_doc`` of ``docs``, with ``position``."""
    best = top_of_each(hits, [doc], order, per_doc)
    leaders = best.where("position = 1").orderBy(*order).limit(docs).select(doc)
    return best.join(F.broadcast(leaders), doc, "left_semi")  # a few rows


def hybrid(keyword: DataFrame, vector: DataFrame, key: str, k: int) -> DataFrame:
    """(key, rrf_score, similarity, keyword_rank, confidence): the k best of two ranked lists fused.

    ``keyword`` (key, rank) and ``vector`` (key, rank, score) hold 2 k rows each. A keyword hit counts as found by a
    keyword strength of 1 / rank.
    """
    fused = fuse([keyword, vector], key)
    d = fused.join(vector.select(key, F.col("score").alias("similarity")), key, "left").join(keyword.select(key, F.col("rank").alias("keyword_rank")), key, "left")
    label = confidence(F.coalesce("similarity", F.lit(0.0)), F.coalesce(1 / F.col("keyword_rank"), F.lit(0.0)))
    return d.withColumn("confidence", label).orderBy(F.desc(F.round("rrf_score", 12)), key).limit(k)


def united(hits: list[DataFrame], key: str, order: str) -> DataFrame:
    """Hits (key, order, ...) of a query and of its rewritten forms: each key once, from the first form that found it."""
    parts = [h.withColumn("variant", F.lit(i)) for i, h in enumerate(hits)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first = Window.partitionBy(key).orderBy("variant", order)
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def unseen(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of ``rows`` that are not among ``seen``."""
    return rows.select(*key).distinct().join(seen.select(*key).distinct(), key, "left_anti")
