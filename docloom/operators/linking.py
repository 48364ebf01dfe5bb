"""Names in texts by an automaton or, for large tables of names, by substrings; names in names; prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from docloom.operators.ordering import checkpointed, small_or_shuffled

#: Long texts are cut into blocks of so many characters, which overlap by the longest name.
BLOCK_CHARS = 512

#: An automaton holds names of about so many characters together, some 100 bytes each.
AUTOMATON_CHARS = 1_000_000
#: Texts are read by so many automata at most, one after another; cutting them into substrings costs as much as some twenty.
AUTOMATA = 16
#: Rows of hits that a worker gathers before it hands them on.
HIT_ROWS = 10_000


def _lengths(names: DataFrame, name: str) -> list[int]:
    """The different lengths of names, shortest first: as many numbers as the longest name has characters at most."""
    return sorted(r[0] for r in names.select(F.length(name)).distinct().collect())


@lru_cache(maxsize=1)
def _automaton(names: Broadcast) -> ahocorasick.Automaton:
    """The automaton of the names sent to a worker, built once there."""
    found = ahocorasick.Automaton()
    for name in names.value:
        found.add_word(name, name)
    found.make_automaton()
    return found


def _by_automaton(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(_k, name, at) for each text (_k, _t), read once from left to right whatever the number of names."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast([r[0] for r in names.collect()])  # the caller has measured them
    kind = texts.schema["_k"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value:
            return
        automaton = _automaton(sent)
        for batch in batches:
            rows, found, at = [], [], []

            def hits() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(at, pa.int32())], ["_k", "name", "at"])

            for i, text in enumerate(batch.column(1)):
                first: dict[str, int] = {}
                for end, name in automaton.iter(text.as_py()):
                    first.setdefault(name, end - len(name) + 1)
                rows += [i] * len(first)
                found += first.keys()
                at += first.values()
                if len(rows) >= HIT_ROWS:
                    yield hits()
                    rows, found, at = [], [], []
            if rows:
                yield hits()

    schema = StructType().add(kind).add("name", StringType()).add("at", IntegerType())
    return texts.mapInArrow(find, schema)


def _by_substrings(texts: DataFrame, names: DataFrame, lengths: list[int]) -> DataFrame:
    """(_k, name, at): texts are cut into substrings of the lengths that names have, which meet the names in an equi-join."""
    d = texts.where(F.length("_t") >= lengths[0])
    d = d.select("_k", "_t", F.explode(F.sequence(F.lit(0), F.length("_t") - 1, F.lit(BLOCK_CHARS))).alias("_b"))
    d = d.select("_k", "_b", F.substring(F.col("_t"), F.col("_b") + 1, F.lit(BLOCK_CHARS + lengths[-1] - 1)).alias("_t"))
    starts = F.sequence(F.lit(0), F.least(F.lit(BLOCK_CHARS), F.length("_t")) - 1)
    # one short cut at each place first, so that only places where some name may begin are cut at all lengths
    d = d.select("_k", "_b", "_t", F.explode(starts).alias("_s")).withColumn("_p", F.substring(F.col("_t"), F.col("_s") + 1, F.lit(lengths[0])))
    d = d.join(small_or_shuffled(names.select(F.substring("name", 1, lengths[0]).alias("_p")).distinct()), "_p", "left_semi")
    cuts = F.filter(F.array(*[F.when(F.length("_t") >= F.col("_s") + n, F.substring(F.col("_t"), F.col("_s") + 1, F.lit(n))) for n in lengths]), lambda x: x.isNotNull())
    d = d.select("_k", (F.col("_b") + F.col("_s")).alias("at"), F.explode(cuts).alias("name"))
    return d.join(small_or_shuffled(names), "name").select("_k", "name", "at")


def named_in(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(key, name, at): names that stand anywhere in a text, with the 0-based place of the first occurrence.

    Names go to the workers as automata (Aho and Corasick, 1975) of about ``most_chars`` characters each, and a text makes
    a row for each name it holds; where more than ``AUTOMATA`` would be needed, names are joined with the texts'
    substrings, which gives the same rows.
    Null and empty texts and names never match; letters keep their case; texts of one key count as one, the least place
    of a name in any of them.
    """
    names = checkpointed(names.select(F.col(name).alias("name")).where("name != ''").distinct())
    lengths = _lengths(names, "name")
    if not lengths:
        return texts.select(F.col(key), F.lit("").alias("name"), F.lit(0).alias("at")).limit(0)
    d = texts.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t != ''")
    parts = -(-names.agg(F.sum(F.length("name"))).first()[0] // max(1, most_chars))
    if parts <= AUTOMATA:
        found = reduce(DataFrame.union, [_by_automaton(d, names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i)) for i in range(parts)])
    else:
        found = _by_substrings(d, names, lengths)
    return found.groupBy(F.col("_k").alias(key), "name").agg(F.min("at").alias("at"))


def name_pairs(names: DataFrame, group: str, name: str) -> DataFrame:
    """(group, long, short): each distinct name of a group and every other name of it that stands inside."""
    n = checkpointed(names.select(F.col(group).alias("_g"), F.col(name).alias("_n")).where("_n != ''").distinct())
    lengths = _lengths(n, "_n")
    if len(lengths) < 2:
        return n.select(F.col("_g").alias(group), F.col("_n").alias("long"), F.col("_n").alias("short")).limit(0)
    d = n.select("_g", "_n", F.explode(F.filter(F.lit(lengths), lambda x: x < F.length("_n"))).alias("_l"))
    d = d.select("_g", "_n", F.explode(F.transform(F.sequence(F.lit(0), F.length("_n") - F.col("_l")), lambda i: F.substring(F.col("_n"), i + 1, F.col("_l")))).alias("_s")).distinct()
    short = n.select(F.col("_g").alias("_h"), F.col("_n").alias("short"))
    return d.join(short, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_s") == F.col("short"))).select(F.col("_g").alias(group), F.col("_n").alias("long"), "short")


def find_names(asked: DataFrame, query: str, entities: DataFrame, name: str, order: str) -> DataFrame:
    """(query, name, how): for each distinct query the entity of that name, any case; else the first in order whose name
    holds the query or is held by it; queries without either are left out."""
    e = entities.select(F.col(name).alias("_name"), F.lower(F.col(name)).alias("_low"), F.col(order).alias("_o")).where("_low != ''")
    q = asked.select(F.col(query).alias("_q"), F.lower(F.col(query)).alias("_low")).where("_low != ''").distinct()
    exact = q.join(e, "_low").select("_q", "_name", "_o", F.lit(0).alias("_p"))
    pairs = name_pairs(e.select("_low").union(q.select("_low")).withColumn("_g", F.lit(0)), "_g", "_low").select("long", "short")
    both = checkpointed(pairs.union(pairs.select("short", "long")).toDF("_ql", "_el"))
    part = q.join(both, F.col("_low") == F.col("_ql")).select("_q", "_el").join(e, F.col("_el") == F.col("_low")).select("_q", "_name", "_o", F.lit(1).alias("_p"))
    best = exact.unionByName(part).groupBy("_q").agg(F.min_by(F.struct("_name", "_p"), F.struct("_p", "_o", "_name")).alias("b"))
    return best.select(F.col("_q").alias("query"), F.col("b._name").alias("name"), F.when(F.col("b._p") == 0, "exact").otherwise("partial").alias("how"))


def by_prefix(citations: DataFrame, key: str, text: str, documents: DataFrame, doc: str) -> DataFrame:
    """(key, doc): the longest document id that a citation begins with; null where there is none."""
    ids = checkpointed(documents.select(F.col(doc).cast("string").alias("_d")).where("_d != ''").distinct())
    c = citations.select(F.col(key), F.col(text).alias("_t"))
    lengths = _lengths(ids, "_d")
    if not lengths:
        return c.select(key, F.lit(None).cast("string").alias("doc"))
    tried = c.select(key, "_t", F.explode_outer(F.array_distinct(F.transform(F.lit(lengths), lambda n: F.substring(F.col("_t"), F.lit(1), n)))).alias("_p"))
    found = tried.join(small_or_shuffled(ids), F.col("_p") == F.col("_d"), "left")
    return found.groupBy(key, "_t").agg(F.max_by("_d", F.length("_d")).alias("doc")).select(key, "doc")


def verified_references(references: DataFrame, key: str, reference: str, documents: DataFrame, doc: str) -> DataFrame:
    """(key, reference, verified): whether a reference holds a known document or chunk id, any case."""
    r = references.select(F.col(key), F.col(reference).alias("reference"), F.lower(reference).alias("_low"))
    known = named_in(r.select("_low").distinct(), "_low", "_low", documents.select(F.lower(F.col(doc).cast("string")).alias("_d")), "_d").select(F.col("_low").alias("_f")).distinct()
    return r.join(known, F.col("_low") == F.col("_f"), "left").select(key, "reference", F.col("_f").isNotNull().alias("verified"))


def reference_warnings(verified: DataFrame, key: str) -> DataFrame:
    """(key, unverified, total) of those with more than half of their references unverified."""
    g = verified.groupBy(key).agg(F.count_if(~F.col("verified")).alias("unverified"), F.count("*").alias("total"))
    return g.where(F.col("unverified") > F.floor(F.col("total") / 2))


def link_first(rows: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, text): the first occurrence of each term (key, term, target) outside of links becomes ``[[target|term]]``.

    A term must stand between word boundaries. Longer terms come first, so a term inside a longer one is not linked in it.
    """
    order = F.struct((-F.length("term")).alias("n"), "term", "target")
    own = terms.where("term != ''").groupBy(F.col(key).alias("_k")).agg(F.transform(F.sort_array(F.collect_set(order)), lambda x: F.struct(x["term"].alias("term"), x["target"].alias("target"))).alias("_terms"))

    def put(t, x):
        link = F.concat(F.lit("[["), x["target"], F.lit("|"), x["term"], F.lit("]]"))
        escaped = F.regexp_replace(x["term"], r"([^\p{L}\p{N}\s])", r"\\$1")
        pattern = F.concat(F.lit(r"(?s)^(.*?)(?<![\p{L}\p{N}_])"), escaped, F.lit(r"(?![\p{L}\p{N}_])"))
        parts = F.split(t, r"(?=\[\[)|(?<=\]\])")  # links stand alone
        places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: ~F.get(parts, i).startswith("[[") & F.regexp_like(F.get(parts, i), pattern))
        first = F.get(places, F.lit(0))
        head = F.call_function("regexp_extract", F.get(parts, first), pattern, F.lit(1))
        tail = F.substring(F.get(parts, first), F.length(head) + F.length(x["term"]) + 1, F.length(t))
        before, after = F.array_join(F.slice(parts, F.lit(1), first), ""), F.array_join(F.slice(parts, first + 2, F.size(parts)), "")
        return F.when(first.isNotNull(), F.concat(before, head, link, tail, after)).otherwise(t)

    d = rows.join(own, F.col(key) == F.col("_k"), "left")
    return d.select(F.col(key), F.when(F.col("_terms").isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.aggregate("_terms", F.col(text), put)).alias("text"))
