"""Chat formatting: logged snapshots that a longer conversation continues are dropped, the rest rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import checkpointed, small_or_shuffled

#: Turns in one step of the two-level prefix hashes, and in one rendered part.
BLOCK = 64
#: What tells conversations apart: whether the id is null, and the id; equality on them needs no special join.
CONV = ["no_id", "cid"]


def _identified(conversations: DataFrame) -> DataFrame:
    """no_id, cid, numbered, t (the turn, 0 for null), digest (of role and text, 128 bits), role, text of every row."""
    kind = conversations.schema["conv_id"].dataType
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.col("role").isNull().cast("int"), F.col("text").isNull().cast("int"), F.lit(":"), F.char_length(role), F.lit(":"), role, text)
    return conversations.select(
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce("conv_id", F.lit(0).cast(kind)).alias("cid"),
        F.col("turn").isNotNull().alias("numbered"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"),
        F.md5(content).alias("digest"),
        "role",
        "text",
    )


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns without their texts: no_id, cid, place, numbered, t, digest; checkpointed.

    ``place`` is the turn's number less the conversation's first; turns without a number come first, at -1.
    """
    turns = checkpointed(_identified(conversations).select(*CONV, "numbered", "t", "digest").distinct())
    first = small_or_shuffled(checkpointed(turns.where("numbered").groupBy(*CONV).agg(F.min("t").alias("first"))))
    place = F.when(F.col("numbered"), F.col("t") - F.col("first")).otherwise(F.lit(-1)).cast("long")
    return turns.join(first, CONV, "left").select(*CONV, place.alias("place"), "numbered", "t", "digest")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """no_id, cid, place, h1, h2, n: hash and number of all turns up to each place, by sums of blocks and within blocks.

    A turn counts by two 64-bit hashes of its place and digest; prefixes combine them by exclusive or.
    """
    own = [F.xxhash64(F.lit(i), "place", "digest").alias(f"h{i}") for i in (1, 2)]
    one = turns.select(*CONV, "place", *own).groupBy(*CONV, "place").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("n"))
    one = one.withColumn("block", F.floor(F.col("place") / BLOCK))
    blocks = one.groupBy(*CONV, "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.sum("n").alias("bn"))
    before = Window.partitionBy(*CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*CONV, "block", *[F.coalesce(f(c).over(before), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "b1"), (F.bit_xor, "b2"), (F.sum, "bn"))])
    within = Window.partitionBy(*CONV, "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = one.select(*CONV, "block", "place", *[f(c).over(within).alias(c) for f, c in ((F.bit_xor, "h1"), (F.bit_xor, "h2"), (F.sum, "n"))])
    joined = own.join(blocks, [*CONV, "block"])
    return joined.select(*CONV, "place", F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"), (F.col("n") + F.col("bn")).alias("n"))


def _maximal(turns: DataFrame) -> DataFrame:
    """no_id, cid, n_turns, copies of conversations that no longer one begins with."""
    prefixes = checkpointed(prefix_hashes(turns))
    whole = small_or_shuffled(checkpointed(prefixes.groupBy(*CONV).agg(F.max("place").alias("last"))))
    marked = prefixes.join(whole, CONV)
    full = marked.where("place = last").groupBy("h1", "h2", "n").agg(F.min(F.struct(*CONV)).alias("c"), F.count("*").alias("copies"))
    proper = marked.where("place < last").select("h1", "h2", "n").distinct()
    return full.join(proper, ["h1", "h2", "n"], "left_anti").select("c.*", F.col("n").alias("n_turns"), "copies")


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of conversations that no longer one begins with.

    A conversation is its distinct (turn, role, text) rows in the order of turn, counted from its first turn; rows with
    the same turn stand together, in any order; rows without a turn come first. It is a snapshot of a longer one whose
    first turns are equal to it, each role and text, null being equal to null. Of equal conversations the one with the
    smallest conv_id stays, null last, and ``copies`` says how many there are.

    Texts are hashed at the scan and stay there. Each conversation's turns are hashed with their places; exclusive or
    makes prefix hashes that can be summed in blocks of turns, so that neither a very long conversation nor one logged
    many times meets in one task. Distinct prefixes and distinct whole hashes meet in an anti-join.
    """
    return _maximal(placed_turns(conversations)).select(F.when(~F.col("no_id"), F.col("cid")).alias("conv_id"), "n_turns", "copies")


def _numbered(turns: DataFrame) -> DataFrame:
    """no_id, cid, numbered, t, digest and ``rank``, from 0, of each turn in its conversation; checkpointed.

    Turns are sorted in range partitions and numbered by offsets, so that a conversation of any length, or any number of
    turns at one place, never meets in one task.
    """
    order = [*CONV, "place", "digest"]
    d = turns.select(*order, "numbered", "t").repartitionByRange(*order).sortWithinPartitions(*order)
    d = checkpointed(d.withColumn("at", F.monotonically_increasing_id())).withColumn("run", F.shiftright("at", 33))  # the partition's number
    runs = d.groupBy(*CONV, "run").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*CONV).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = checkpointed(runs.select(*CONV, "run", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start")).alias("shift")))
    return checkpointed(d.join(small_or_shuffled(runs), [*CONV, "run"]).select(*CONV, "numbered", "t", "digest", (F.col("at") + F.col("shift")).alias("rank")))


def rendered(conversations: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """conv_id, part, n_turns, copies, text: each maximal conversation in ChatML, a row for every 64 turns.

    Turns stand in the order of their numbers, those without one first; several of one number stand in the order of a
    digest of role and text. Parts bound a row whatever the length of a conversation, in turns; their texts end to end, in
    order, are the whole. Only texts of kept conversations are shuffled, once; those of conversations of more than 64
    turns twice, as they are looked up by turn first. The markers that stand in a message are broken by a blank after
    ``<``, so no message can forge a turn. A null role is written as ``user``, a null text as empty. Rows without a
    conv_id are one conversation; repeated rows count once; no rows give none.
    """

    def safe(c: Column) -> Column:
        for mark in (opening, closing):
            c = F.replace(c, F.lit(mark), F.lit(mark[0] + " " + mark[1:]))
        return c

    turns = placed_turns(conversations)
    kept = checkpointed(_maximal(turns))
    line = F.concat(F.lit(opening), safe(F.coalesce("role", F.lit("user"))), F.lit("\n"), safe(F.coalesce("text", F.lit(""))), F.lit(closing + "\n"))
    lines = _identified(conversations).select(*CONV, "numbered", "t", "digest", line.alias("line"))
    own = [*CONV, "part", "n_turns", "copies"]

    short = lines.join(small_or_shuffled(kept.where(F.col("n_turns") <= BLOCK)), CONV).withColumn("part", F.lit(0).cast("long"))
    out = short.groupBy(*own).agg(F.sort_array(F.collect_set(F.struct("numbered", "t", "digest", "line"))).alias("lines")).select(*own, F.col("lines.line").alias("lines"))
    long = kept.where(F.col("n_turns") > BLOCK)
    if not long.isEmpty():
        ranks = checkpointed(_numbered(turns.join(small_or_shuffled(long.select(*CONV)), CONV, "left_semi")).join(small_or_shuffled(long), CONV))
        parted = lines.join(small_or_shuffled(long.select(*CONV)), CONV, "left_semi").join(small_or_shuffled(ranks), [*CONV, "numbered", "t", "digest"])
        parted = parted.withColumn("part", F.floor(F.col("rank") / BLOCK).cast("long"))
        out = out.unionByName(parted.groupBy(*own).agg(F.sort_array(F.collect_set(F.struct("rank", "line"))).alias("lines")).select(*own, F.col("lines.line").alias("lines")))
    return out.select(F.when(~F.col("no_id"), F.col("cid")).alias("conv_id"), "part", "n_turns", "copies", F.array_join("lines", "").alias("text"))


#: DuckDB SQL of the registered query.
ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
f AS (SELECT conv_id, coalesce(turn - min(turn) OVER (PARTITION BY conv_id), -1) AS place, role, text,
             md5((role IS NULL)::INT || '' || (text IS NULL)::INT || ':' || length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM t),
p AS (SELECT conv_id, place, list(place || ':' || digest) OVER (PARTITION BY conv_id ORDER BY place, digest RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
             lead(place) OVER (PARTITION BY conv_id ORDER BY place, digest) AS later, count(*) OVER (PARTITION BY conv_id) AS n FROM f),
e AS (SELECT conv_id, l, n FROM p WHERE later IS NULL OR later <> place),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, l FROM e WHERE len(l) = n GROUP BY l),
m AS (SELECT conv_id, copies, len(l) AS n_turns FROM w WHERE l NOT IN (SELECT l FROM e WHERE len(l) < n)),
k AS (SELECT conv_id, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY place, digest) - 1) / 64) AS BIGINT) AS part, place, digest, role, text FROM f),
r AS (SELECT conv_id, part, string_agg('<|im_start|>' || replace(replace(coalesce(role, 'user'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10) ||
             replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY place, digest) AS text
      FROM k GROUP BY conv_id, part)
SELECT m.conv_id, part, CAST(n_turns AS BIGINT) AS n_turns, copies, text FROM m JOIN r ON m.conv_id IS NOT DISTINCT FROM r.conv_id
"""
