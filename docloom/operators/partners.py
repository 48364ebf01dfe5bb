"""Affinity without all pairs: of the pairs that are asked for, and of the best partners of every entity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import cells, wedges
from docloom.operators.fusion import top_of_each
from docloom.operators.graph import both_ways, by_common, by_weight, scored
from docloom.operators.ordering import checkpoint_folder, checkpointed, numbered, removed, small_or_shuffled

#: Scores are compared after this rounding, and bounds keep this distance from what they bound.
DIGITS, MARGIN = 9, 1e-6
#: Names of 2 ** HUB links or more are hubs; wedges that a block of names has, about.
HUB, WEDGES = 10, 16_000_000
#: Neighbours that a row lists, about; names in order whose rows are written together.
LIST, NEAR = 65_536, 512


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src != dst").distinct()


def _in_common(pairs: DataFrame, links: DataFrame, sizes: DataFrame) -> DataFrame:
    """(src, dst, n_src, n_dst, of): a row for each thing ``of`` that both ends of a pair are linked to.

    ``links`` (name, of) are distinct, ``sizes`` (name, n) count them. The end with fewer links is read out and the other
    one looked up by (name, of), so a pair costs its smaller end, and a hub's links are spread by what they lead to.
    """
    p = pairs
    for end in ("src", "dst"):
        p = p.join(sizes.select(F.col("name").alias(end), F.col("n").alias(f"n_{end}")), end)
    few = F.col("n_src") <= F.col("n_dst")
    p = p.select("src", "dst", "n_src", "n_dst", F.when(few, F.col("src")).otherwise(F.col("dst")).alias("name"), F.when(few, F.col("dst")).otherwise(F.col("src")).alias("other"))
    return p.join(links, "name").join(links.select(F.col("name").alias("other"), "of"), ["other", "of"]).select("src", "dst", "n_src", "n_dst", "of")


def _direct(edges: DataFrame) -> DataFrame:
    d = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src != dst")
    return d.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def affinity_of(pairs: DataFrame, edges: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(src, dst, adamic_adar, shared, affinity) of the pairs asked for (src, dst), as ``graph.affinity`` scores them.

    Each different pair has one row, the smaller name first; pairs of nothing in common score 0, those with a null or of a
    name with itself have no row. Work grows with the sum of the smaller ends' neighbours, never with pairs around a hub.
    """
    p = checkpointed(_ordered(pairs))
    if p.isEmpty():
        return scored(p.select("*", *[F.lit(None).cast("double").alias(c) for c in ("weight", "adamic_adar", "shared")]))
    e = checkpointed(both_ways(edges).select(F.col("src").alias("name"), F.col("dst").alias("of")))
    degree = checkpointed(e.groupBy("name").agg(F.count("*").alias("n")))
    weights = degree.where("n > 1").select(F.col("name").alias("of"), (1 / F.ln("n")).alias("w"))
    common = _in_common(p, e, degree).join(weights, "of").groupBy("src", "dst").agg(F.sum("w").alias("adamic_adar"))
    d = p.join(_direct(edges), ["src", "dst"], "left").join(common, ["src", "dst"], "left")
    if documents is None:
        return scored(d.withColumn("shared", F.lit(0.0)))
    m = checkpointed(documents.select("name", F.col("doc").alias("of")).where("name IS NOT NULL AND of IS NOT NULL").distinct())
    both = _in_common(p, m, m.groupBy("name").agg(F.count("*").alias("n")))
    both = both.groupBy("src", "dst").agg((F.count("*") / F.min(F.least("n_src", "n_dst"))).alias("shared"))
    return scored(d.join(both, ["src", "dst"], "left"))


def _undecided(pairs: DataFrame, group: list[str], n: int) -> DataFrame:
    """Of ``pairs`` (name, partner, low, high) those that may be among the n best of their group: no n others surely come
    before them, by a larger ``low`` or by an equal one and a smaller name."""
    best = Window.partitionBy(*group).orderBy(F.desc("_low"), "partner")
    d = pairs.withColumn("_low", F.round("low", DIGITS))
    d = d.withColumn("_place", F.row_number().over(best))
    d = d.withColumn("_nth", F.max(F.when(F.col("_place") == n, F.struct("_low", "partner"))).over(Window.partitionBy(*group)))
    after = (F.col("high") < F.col("_nth._low") - MARGIN) | ((F.round("high", DIGITS) == F.col("_nth._low")) & (F.col("partner") > F.col("_nth.partner")))
    return d.where(~F.coalesce(after, F.lit(False))).drop("_low", "_place", "_nth")


def best_partners(edges: DataFrame, n: int) -> DataFrame:
    """(name, partner, adamic_adar, affinity, position): for every entity the n with the largest affinity by edges and common
    neighbours, ties by name; exact, and with all partners of those that have fewer. Null names have no edges.

    Wedges through neighbours of fewer than 2 ** HUB links are summed up in arrays, by blocks of names: each name's list of
    neighbours is sent once to every block that needs it, and of the pairs only each name's best leave the task.

    Through hubs few wedges are made. Co-occurring pairs and, through each neighbour, its first n + 1 neighbours by name give
    n partners whose scores bound the n-th best from below. An entity's largest hubs, whose whole contributions stay below
    that bound, cannot lift anyone over it who shares nothing else; a single largest hub never needs its pairs, as whoever
    shares it alone scores as much as its first neighbours by name and comes after them. Hubs are left out by classes of
    degrees (powers of two). What the bounds leave is scored exactly.

    A star of any size makes n + 1 rows for each edge. Where entities share several hubs and nothing else, scores tie with
    the bound, and only the largest hub is left out.
    """
    folder = f"{checkpoint_folder(edges.sparkSession)}/partners_{uuid.uuid4().hex}"
    try:
        return checkpointed(_best(edges, n, folder))
    finally:
        removed(edges.sparkSession, folder)


def _written(rows: DataFrame, folder: str) -> DataFrame:
    """``rows``, from files that take less disk than a checkpoint."""
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _best(edges: DataFrame, n: int, folder: str) -> DataFrame:
    spark = edges.sparkSession
    half = _written(_direct(edges), f"{folder}/edges")
    degree = half.select(F.col("src").alias("name")).union(half.select("dst")).groupBy("name").agg(F.count("*").alias("n"))
    names = checkpointed(numbered(degree, [], ["name"], "id").select("name", F.col("id").cast("int").alias("id"), "n", F.floor(F.log2("n")).cast("int").alias("class")))
    links, most = names.agg(F.sum("n"), F.max("class")).first()
    # names by their numbers, and around each name its neighbours and what edges to them score; large ones in several rows
    known = small_or_shuffled(names)
    ends = half.select("src", "dst", by_weight(F.col("weight")).alias("direct"))
    for end, i in (("src", "s"), ("dst", "t")):
        ends = ends.join(known.select(F.col("name").alias(end), F.col("id").alias(i), F.col("n").alias(f"{i}_n"), F.col("class").alias(f"{i}_class")), end).drop(end)
    there = ends.select(F.col("s").alias("id"), F.col("s_n").alias("n"), F.col("s_class").alias("class"), F.col("t").alias("of"), F.col("t_n").alias("of_n"), F.col("t_class").alias("of_class"), "direct")
    d = there.union(ends.select("t", "t_n", "t_class", "s", "s_n", "s_class", "direct"))
    small = F.when((F.col("of_n") > 1) & (F.col("of_class") < HUB), F.col("of_n")).otherwise(0)
    d = d.select(F.floor(F.col("id") / NEAR).cast("int").alias("near"), "id", "n", "class", F.pmod("of", F.ceil(F.col("n") / LIST)).cast("int").alias("chunk"), "of", "direct", (small + 1).alias("cost"))
    d = d.repartition(cells.tasks(spark, links or 0, LIST * 8), "near").groupBy("near", "id", "n", "class", "chunk")
    d = d.agg(F.sort_array(F.collect_list(F.struct("of", "direct"))).alias("o"), F.sum("cost").alias("cost"))
    nodes = _written(d.select("id", "n", "class", "chunk", F.col("o.of").alias("ids"), F.col("o.direct").alias("worth"), "cost"), f"{folder}/nodes")

    hubs = (most or 0) >= HUB
    rule, seeds = _left_out(nodes, names, n) if hubs else (None, None)
    where = nodes.groupBy("id").agg(F.sum("cost").alias("cost"))
    if hubs:
        where = where.join(rule.select("id", "kept"), "id", "left").select("id", (F.col("cost") + F.coalesce("kept", F.lit(0))).alias("cost"))
    where, blocks = _blocks(where)
    of_block = small_or_shuffled(where)
    key, none = ["block", "alone", "part"], F.lit(None).cast("double")
    each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    own = nodes.join(of_block, "id")
    needed = own.select("block", "alone", "parts", "id", F.explode("ids").alias("of"))
    if hubs:
        own = own.join(small_or_shuffled(rule.drop("kept")), "id", "left")
        needed = needed.join(small_or_shuffled(rule.select("id", "from_class", "largest")), "id", "left").join(small_or_shuffled(names.where(F.col("class") >= HUB).select(F.col("id").alias("of"), F.col("class").alias("of_class"))), "of", "left")
        needed = needed.where(F.col("of_class").isNull() | F.coalesce(F.col("of_class") < F.col("from_class"), F.col("of") != F.col("largest")))
    else:
        own = own.select("*", none.alias("bound"), none.alias("skipped"), none.alias("from_class"), none.alias("largest"))
    rules = [F.coalesce("bound", F.lit(0.0)).alias("bound"), F.coalesce("skipped", F.lit(0.0)).alias("skipped"), F.col("from_class").cast("double").alias("from_class"), F.col("largest").cast("double").alias("largest")]
    rows = own.select("block", "alone", "parts", each_part, F.lit(0).alias("kind"), "id", none.alias("degree"), none.alias("class"), "ids", "worth", *rules)
    of_part = F.when(F.col("parts") == 1, F.col("ids")).otherwise(F.filter("ids", lambda x: F.pmod(x, F.col("parts")) == F.col("part")))
    shape = lambda d, kind, worth: d.select("block", "alone", "parts", "part", F.lit(kind).alias("kind"), "id", F.col("n").cast("double").alias("degree"), F.col("class").cast("double").alias("class"), of_part.alias("ids"), worth.alias("worth"), *[none.alias(c) for c in ("bound", "skipped", "from_class", "largest")])
    shared = nodes.where("n > 1").select("id", "n", "class", "ids").join(needed.select("block", "alone", "parts", F.col("of").alias("id")).distinct(), "id")
    rows = rows.unionByName(shape(shared.select("*", each_part), 1, F.lit(None).cast("array<double>")))
    if hubs:
        told = seeds.join(of_block, "id").select("*", each_part).where(F.pmod("partner", "parts") == F.col("part"))
        told = told.groupBy("block", "alone", "parts", "part", "id").agg(F.collect_list(F.struct("partner", "seen")).alias("o"))
        told = told.select("block", "alone", "parts", "part", "id", none.alias("n"), none.alias("class"), F.col("o.partner").alias("ids"), F.col("o.seen").alias("seen"))
        rows = rows.unionByName(shape(told, 2, F.col("seen")))
    found = rows.repartition(cells.tasks(spark, blocks, 1), *key).groupBy(*key).applyInArrow(wedges.best_of_block(n, DIGITS, MARGIN), wedges.SCHEMA)
    found = checkpointed(found)

    left = found.where("NOT exact").select(F.col("id").alias("name"), "partner", "low", "high")
    asked = _named(_undecided(left, ["name"], n).select("name", "partner"), names, known).select(F.col("name").alias("src"), F.col("partner").alias("dst"))
    asked = checkpointed(asked)
    scores = affinity_of(asked, half)
    out = asked.select(F.col("src").alias("name"), F.col("dst").alias("partner"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).join(scores, ["src", "dst"])
    exact = found.where("exact").select(F.col("id").alias("name"), "partner", "adamic_adar", F.col("low").alias("affinity"))
    out = _named(exact, names, known).unionByName(out.select("name", "partner", "adamic_adar", "affinity"))
    return top_of_each(out, ["name"], [F.desc(F.round("affinity", DIGITS)), F.col("partner")], n).select("name", "partner", "adamic_adar", "affinity", "position")


def _named(pairs: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` of numbers (name, partner, ...) with the names instead."""
    d = pairs
    for end in ("name", "partner"):
        d = d.withColumnRenamed(end, "id").join(known.select("id", F.col("name").alias(f"_{end}")), "id").drop("id")
    return d.withColumnsRenamed({"_name": "name", "_partner": "partner"}).select(*pairs.columns)


def _left_out(nodes: DataFrame, names: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Of names beside a hub (id, bound, from_class, largest, skipped, kept): their hubs of a class (power of two of its
    degree) from ``from_class`` on, or where that is null their ``largest``, are left out; together they give ``skipped``, and
    ``kept`` is what links the others have. And (id, partner, seen): partners whose common neighbours give ``seen`` or more.
    """
    sizes = small_or_shuffled(names.select(F.col("id").alias("of"), F.col("n").alias("degree"), F.col("class").alias("of_class")))
    at_hub = nodes.where(F.col("class") >= HUB).select(F.explode("ids").alias("id"), F.col("id").alias("of"), F.col("n").alias("degree"), (1 / F.ln("n")).alias("w"), "class")
    at_hub = checkpointed(at_hub)
    beside = at_hub.select("id").distinct()
    around = nodes.join(beside, "id", "left_semi").select("id", F.explode(F.arrays_zip("ids", "worth")).alias("o")).select("id", F.col("o.ids").alias("of"), F.col("o.worth").alias("direct"))
    heads = top_of_each(nodes.where("n > 1").select(F.col("id").alias("of"), F.explode(F.slice("ids", 1, n + 1)).alias("partner")), ["of"], [F.col("partner")], n + 1).select("of", "partner")
    seeds = around.join(sizes, "of").where("degree > 1").join(heads, "of").where("id != partner").groupBy("id", "partner").agg(F.sum(1 / F.ln("degree")).alias("seen"))
    seeds = checkpointed(seeds)
    told = around.select("id", F.col("of").alias("partner"), "direct").join(seeds, ["id", "partner"], "full_outer")
    least = told.select("id", "partner", F.greatest(F.coalesce("direct", F.lit(0.0)), by_common(F.coalesce("seen", F.lit(0.0)))).alias("low"))
    least = top_of_each(least, ["id"], [F.desc("low")], n).groupBy("id").agg(F.count("*").alias("found"), F.min("low").alias("low"))
    bound = checkpointed(least.select("id", F.when(F.col("found") == n, F.col("low")).otherwise(0.0).alias("bound")))

    # an entity has at most 64 classes of hubs; from the largest down, those whose contributions stay below the bound
    classes = at_hub.groupBy("id", "class").agg(F.sum("w").alias("w"), F.sum("degree").alias("degree"))
    falling = Window.partitionBy("id").orderBy(F.desc("class"))
    total = classes.withColumn("total", F.sum("w").over(falling)).withColumn("degrees", F.sum("degree").over(falling)).join(bound, "id")
    by_class = total.where(F.col("total") <= 5 * F.col("bound") - MARGIN).groupBy("id").agg(F.min("class").alias("from_class"), F.max("total").alias("total"), F.max("degrees").alias("degrees"))
    top = at_hub.groupBy("id").agg(F.max(F.struct("degree", "of", "w")).alias("t"), F.sum("degree").alias("all"))
    rule = top.join(by_class, "id", "left").join(bound, "id")
    none_below = F.col("from_class").isNull()
    rule = rule.select("id", "bound", "from_class", F.when(none_below, F.col("t.of")).alias("largest"), F.coalesce("total", "t.w").alias("skipped"), (F.col("all") - F.coalesce("degrees", "t.degree")).alias("kept"))
    return checkpointed(rule), seeds


def _blocks(costs: DataFrame) -> tuple[DataFrame, int]:
    """(id, block, alone, parts) of names (id, cost), and about how many there are: blocks of names in order that cost about
    WEDGES; a name that costs more has its own, ``alone``, in ``parts``."""
    d = costs.withColumn("_g", F.floor(F.col("id") / 1024))
    groups = checkpointed(d.groupBy("_g").agg(F.sum("cost").alias("c")))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # a row for 1024 names
    starts = groups.select("_g", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(starts, "_g").withColumn("_at", F.col("_start") + F.coalesce(F.sum("cost").over(within), F.lit(0)))
    parts = F.ceil(F.col("cost") / WEDGES).cast("int")
    d = d.select("id", F.floor(F.col("_at") / WEDGES).alias("block"), F.when(parts > 1, F.col("id")).otherwise(0).alias("alone"), parts.alias("parts"))
    return checkpointed(d), int((groups.agg(F.sum("c")).first()[0] or 0) // WEDGES) + 1
