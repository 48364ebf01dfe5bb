"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, SIGMOD 2003)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import BROADCAST_ROWS, ascii_lower, checkpointed, count_words, is_small, row_key, small_or_shuffled, without, words_of

#: What parts words before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words; empty if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<long>"))


def _least(grams: Column, span: int) -> Column:
    """The least gram of each window of ``span`` neighbours, by where the window starts."""
    return F.when(F.size(grams) >= span, F.transform(F.sequence(F.lit(0), F.size(grams) - span), lambda i: F.least(*[F.get(grams, i + j) for j in range(span)], F.lit(2**63 - 1)))).otherwise(F.array().cast("array<long>"))


def _placed(df: DataFrame, keep: list[str], k: int, span: int) -> DataFrame:
    """``keep``, pos, w, gram: each word and the k-gram that starts with it, null unless it is least in some window of
    ``span`` neighbouring k-grams. Rows are narrow: no array of a text leaves the step that takes it apart.

    Equal least k-grams are all kept. A run of k + span - 1 words that two texts share holds a whole window, and so a
    k-gram that is kept in both at the same place.
    """
    d = df.withColumn("grams", _grams(F.col("words"), k)).withColumn("least", _least(F.col("grams"), span))
    d = d.select(*keep, "grams", "least", F.posexplode_outer("words").alias("pos", "w"))  # outer: no filter that computes the words twice
    gram = F.get("grams", F.col("pos"))
    kept = reduce(Column.__or__, [F.get("least", F.col("pos") - back) == gram for back in range(span)])
    return d.select(*keep, "pos", "w", F.when(kept, gram).alias("gram"))


def _candidates(docs: DataFrame, prints: DataFrame, begins: DataFrame, window: int, k: int, most_broadcast: int) -> DataFrame:
    """_id, _hash, s, length: where a run of an item may stand in a document, by its k-grams and by first words of short items."""
    key = ["_id", "_hash"]
    places = _placed(docs, key, k, window - k + 1)
    around = F.transform(F.sequence(F.greatest(F.lit(0), F.col("pos") - (window - k)), F.col("pos")), lambda s: F.struct(s.alias("s"), F.lit(window).alias("length")))
    short = F.transform("lengths", lambda n: F.struct(F.col("pos").alias("s"), n.alias("length")))
    none = F.array().cast("array<struct<s:int,length:int>>")
    if is_small(prints, most_broadcast) and is_small(begins, most_broadcast):
        d = places.join(F.broadcast(prints.withColumn("printed", F.lit(True))), "gram", "left").join(F.broadcast(begins), F.col("w") == F.col("first"), "left")
        d = d.where("printed OR first IS NOT NULL")
        at = [d.select(*key, F.concat(F.when(F.col("printed"), around).otherwise(none), F.coalesce(short, none)).alias("at"))]
    else:
        at = [places.where("gram IS NOT NULL").select(*key, "pos", "gram").join(prints, "gram").select(*key, around.alias("at"))]
        at.append(places.select(*key, "pos", "w").join(begins, F.col("w") == F.col("first")).select(*key, short.alias("at")))
    return reduce(DataFrame.union, at).select(*key, F.explode("at").alias("x")).select(*key, "x.s", "x.length")


def _matches(docs: DataFrame, items: DataFrame, runs: DataFrame, window: int, k: int, most_broadcast: int) -> DataFrame:
    """_id, _hash, s, length, wid: where documents hold runs of the items.

    Documents are taken apart into narrow rows. A place counts if its k-gram was kept and is one of the items', or if its
    word begins an item of fewer than ``window`` words. Only texts with such places are opened again, and only there are
    runs put together, inside the text's row, and looked up.
    """
    key = ["_id", "_hash"]
    full = items.where(F.col("length") == window)
    prints = checkpointed(_placed(full, [], k, window - k + 1).where("gram IS NOT NULL").select("gram").distinct())
    short = runs.where(F.col("length") < window)
    begins = checkpointed(short.groupBy(F.substring_index("run", " ", 1).alias("first")).agg(F.collect_set("length").alias("lengths")))
    words = words_of(ascii_lower(F.col("text"))).alias("words")
    places = _candidates(docs.select(*key, words), prints, begins, window, k, most_broadcast)
    places = checkpointed(places.groupBy(F.col("_id").alias("p_id"), F.col("_hash").alias("p_hash")).agg(F.collect_set(F.struct("s", "length")).alias("at")))
    same = F.col("_id").eqNullSafe(F.col("p_id")) & (F.col("_hash") == F.col("p_hash"))
    hit = places.select("p_id", "p_hash")
    if (places.agg(F.sum(F.size("at"))).first()[0] or 0) <= most_broadcast:
        places = F.broadcast(places)
    elif is_small(hit, most_broadcast):  # only texts that may hold a run are shuffled
        docs = docs.join(F.broadcast(hit), same, "left_semi")
    d = docs.join(places, same).select(*key, words, "at")
    inside = F.filter("at", lambda x: x["s"] + x["length"] <= F.size("words"))
    found = F.transform(inside, lambda x: F.struct(x["s"].alias("s"), x["length"].alias("length"), F.array_join(F.slice("words", x["s"] + 1, x["length"]), " ").alias("run")))
    found = d.select(*key, F.explode_outer(found).alias("x")).where("x IS NOT NULL").select(*key, "x.s", "x.length", "x.run")
    return found.join(small_or_shuffled(runs.select("run", "length", "wid"), most_broadcast), ["run", "length"]).select(*key, "s", "length", "wid")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, most_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    Fingerprints of both sides are the winnowed k-grams, chosen so that every shared run of ``window`` words has one in
    common. A shared fingerprint is extended to each run of ``window`` words around it, and the run itself is looked up
    among the items' runs, so every hit is exact. Items of fewer words are one run of their own length, looked up where
    its first word stands, in the same pass. Words of an item with a null id are hit like any others; as it has no id, it
    is counted neither in n_items nor in the hash. Items without words never match; null texts have no words; repeated
    rows get the same result each.

    Fingerprints and runs are distinct before they meet the documents, so a passage that many documents or items share
    never forms pairs: a document meets each of its runs once, and the items of a run join by the run's number.
    """
    items = items.select("item_id", words_of(ascii_lower(F.col("text"))).alias("words")).where(F.size("words") > 0)
    items = checkpointed(items.select("item_id", "words", F.least(F.size("words"), F.lit(window)).alias("length")))
    parts = items.select("item_id", "length", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("s"))
    parts = parts.select("item_id", "length", F.array_join(F.expr("slice(words, s + 1, length)"), " ").alias("run")).distinct()
    runs = checkpointed(parts.groupBy("length", "run").agg(F.count("*").alias("n")).select("length", "run"))
    runs = checkpointed(runs.withColumn("wid", F.monotonically_increasing_id()))
    of_items = checkpointed(parts.where("item_id IS NOT NULL").join(runs, ["length", "run"]).select("wid", "item_id").distinct())

    key = ["_id", "_hash"]
    counted = docs.select(*row_key(), "doc_id", count_words(F.col("text"), SEPARATORS).alias("n_words"))
    nothing = F.sha2(F.lit(""), 256)
    if runs.isEmpty():
        return counted.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), nothing.alias("items_sha256"), F.lit(False).alias("contaminated"), "_id", "_hash")
    hits = checkpointed(_matches(docs.select(*row_key(), "text"), items, runs, window, k, most_broadcast).distinct())
    end = F.col("s") + F.col("length")
    before = F.max(end).over(Window.partitionBy(*key).orderBy("s", "length").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("s"), F.coalesce(before, F.lit(0))))
    covered = hits.select(*key, "s", "length").distinct().select(*key, fresh.alias("fresh")).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    named = hits.select(*key, "wid").distinct().join(small_or_shuffled(of_items, most_broadcast), "wid").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy(*key).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    named = named.withColumnsRenamed({"_id": "m_id", "_hash": "m_hash"})
    covered = covered.withColumnsRenamed({"_id": "c_id", "_hash": "c_hash"})
    marks = covered.join(named, F.col("c_id").eqNullSafe(F.col("m_id")) & (F.col("c_hash") == F.col("m_hash")), "left").select(F.col("c_id").alias("m_id"), F.col("c_hash").alias("m_hash"), "n_hit", "n_items", "items_sha256")
    return counted.join(marks, F.col("_id").eqNullSafe(F.col("m_id")) & (F.col("_hash") == F.col("m_hash")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", nothing).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        "_id",
        "_hash",
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that hold no run of any item, all columns as they came."""
    return without(docs, contamination(docs, items, window, k).where("contaminated"))


#: DuckDB SQL of the registered query.
ORACLE = r"""
WITH lo AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, lo),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, lo),
bi AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
runs AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
         FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi)),
ns AS (SELECT DISTINCT n FROM runs),
dr AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT rid, i, dr.n AS n, item_id FROM dr JOIN runs USING (n, run)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
