"""Entity graphs: joins, neighbours, paths, communities and affinity, all over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import cells
from docloom.operators.ordering import checkpointed, small_or_shuffled

#: Colours of node types.
TYPE_COLORS = {
    "person": "#6366f1",
    "organization": "#f59e0b",
    "location": "#10b981",
    "event": "#ef4444",
    "unknown": "#8b5cf6",
}
#: Members of a record or hub are paired in parts of so many, so that no task holds all pairs of a large one.
PART = 64
#: Rows of records that a task pairs, and pairs that a task groups, about.
TASK_ROWS, TASK_PAIRS = 500_000, 1_000_000
#: Hashes by which rows of records are counted, and rows from which one is dense, as it may have a large record.
HASHES, DENSE = 65_536, 1_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) distinct, each edge in either direction, without loops."""
    e = edges.select("src", "dst").where("src != dst")
    return e.union(e.select("dst", "src")).distinct()


def event_graph(relations: DataFrame) -> DataFrame:
    """(src, dst, label): relations and their reverses, whose label says so."""
    back = relations.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat("label", F.lit("(反向)")).alias("label"))
    return relations.select("src", "dst", "label").unionByName(back)


def within(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(node, distance): all nodes at most ``depth`` steps from any source; each step joins the newly reached only."""
    e = checkpointed(both_ways(edges))
    front = sources.select(F.col("node")).distinct()
    seen = checkpointed(front.withColumn("distance", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        found = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        front = checkpointed(found.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start: str | int, end: str | int, most: int = 6) -> DataFrame:
    """(path, hops): the shortest path, the first in order among equals; no row if there is none within ``most`` steps.

    One path a reached node is kept at each step, so the frontier grows with nodes, not with paths.
    """
    e = checkpointed(both_ways(edges))
    spark = edges.sparkSession
    kind = dict(e.dtypes)["src"]
    front = spark.createDataFrame([(start,)], f"node {kind}").withColumn("path", F.array("node"))
    seen = front
    for _ in range(most):
        if not front.where(F.col("node") == end).isEmpty():
            break
        step = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        front = checkpointed(step.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where(F.col("node") == end).select("path", (F.size("path") - 1).alias("hops"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least label passed on and jumped over until nothing changes."""
    e = checkpointed(both_ways(edges))
    labels = checkpointed(e.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumnRenamed("src", "node"))
    while True:
        near = e.join(labels, e["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        new = labels.join(near, labels["node"] == near["src"]).select("node", F.least("component", "m").alias("component"))
        jump = new.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = checkpointed(new.join(jump, new["component"] == jump["n2"], "left").select("node", F.least("component", F.coalesce("c2", "component")).alias("component")))
        changed = new.join(labels.select("node", F.col("component").alias("old")), "node").where("component != old").isEmpty()
        if changed:
            return new
        labels = new


def label_propagation(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, community): every node takes the label with the largest weight around it, the least among equals.

    Its own label counts as much as its heaviest edge, and even and odd nodes (by a hash) take turns, which keeps
    neighbours from swapping labels for ever. A deterministic stand-in for seeded Louvain that only groups and joins;
    nodes without edges keep to themselves. Ends when two rounds change nothing, or after ``rounds`` with the labels
    reached by then; ``communities.louvain`` rises in every round.
    """
    w = edges.select("src", "dst", "weight").where("src != dst")
    e = w.union(w.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    e = checkpointed(e.unionByName(e.groupBy("src").agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")))
    labels = checkpointed(e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    still = 0
    for r in range(rounds):
        votes = e.join(labels, e["dst"] == labels["node"]).groupBy("src", "community").agg(F.round(F.sum("weight"), 9).alias("votes"))
        best = votes.groupBy("src").agg(F.min_by("community", F.struct(-F.col("votes"), F.col("community"))).alias("best"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        new = checkpointed(labels.join(best, labels["node"] == best["src"], "left").select("node", F.when(turn, F.coalesce("best", "community")).otherwise(F.col("community")).alias("community")))
        same = new.join(labels.select("node", F.col("community").alias("old")), "node").where("community != old").isEmpty()
        still, labels = (still + 1 if same else 0), new
        if still == 2:
            break
    return labels


def path_edges(path: DataFrame, relations: DataFrame) -> DataFrame:
    """(hop, src, dst, label): each step of a path (one row, array ``path``) with the relations (src, dst, label) that carry
    it, in either direction; label is null where an edge has none."""
    steps = path.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("src"), F.get("path", i + 1).alias("dst")))).alias("hop", "s")).select("hop", "s.src", "s.dst")
    known = event_graph(relations).select(F.col("src").alias("a"), F.col("dst").alias("b"), "label").distinct()
    return steps.join(known, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), "left").select("hop", "src", "dst", "label")


def payload(entities: DataFrame, events: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type, color) and edges (source, target, label) of a graph to be drawn.

    ``entities`` (id, name, type), ``events`` (id, date, description, participants: array of entity ids), ``relations`` (src,
    dst, label). Unknown types have the colour of ``unknown``.
    """
    color = F.coalesce(*[F.when(F.col("type") == t, c) for t, c in TYPE_COLORS.items()], F.lit(TYPE_COLORS["unknown"]))
    nodes = entities.select(F.col("id").cast("string").alias("id"), F.col("name").alias("label"), F.coalesce("type", F.lit("unknown")).alias("type")).withColumn("color", color)
    label = F.concat(F.substring(F.coalesce("date", F.lit("")), 1, 10), F.lit(" "), F.substring(F.coalesce("description", F.lit("")), 1, 30))
    happened = events.select(F.col("id").cast("string").alias("id"), label.alias("label"), F.lit("event").alias("type")).withColumn("color", color)
    taking_part = events.select(F.col("id").cast("string").alias("source"), F.explode(F.col("participants").cast("array<string>")).alias("target"), F.lit("participant").alias("label"))
    edges = relations.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "label").unionByName(taking_part)
    return nodes.unionByName(happened), edges


def matching_nodes(nodes: DataFrame, pattern: str, text: str) -> DataFrame:
    """Nodes whose text matches a pattern, case ignored; a pattern that is no regular expression is taken literally."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    return nodes.where(F.col(text).rlike(f"(?i){pattern}"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges inside a set of nodes, and those from the set to its neighbours."""
    return edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")


def _few_and_many(records: DataFrame, record: str, item: str) -> tuple[DataFrame, DataFrame, int]:
    """Pairs of records of up to PART items (b, r, src, dst), lying by ``b``, a hash of the record; those of larger records
    (r, src, dst); and how many there are in all, or more where small records repeat items.

    No step holds more than a task's share of rows or pairs: there are as many partitions as those take.
    """
    spark, n, pairs = records.sparkSession, F.count("*").alias("n"), F.col("n") * (F.col("n") - 1) / 2
    d = records.select(F.col(record).alias("r"), F.col(item).alias("i")).where("r IS NOT NULL AND i IS NOT NULL").withColumn("b", F.pmod(F.xxhash64("r"), F.lit(HASHES)))
    # counted first, so that no list of a large record is ever made: by hashes, whose number is fixed, and then by records;
    # only those of a hash of many rows are counted before rows are sent, as one of them may be large
    hashes = checkpointed(d.groupBy("b").agg(n))
    rows = hashes.agg(F.sum("n")).first()[0] or 0
    tasks = cells.tasks(spark, rows, TASK_ROWS)
    dense = F.broadcast(hashes.where(F.col("n") > max(DENSE, 4 * rows // HASHES)).select("b"))
    counted = d.join(dense, "b", "left_anti").repartition(tasks, "b").groupBy("b", "r").agg(n).unionByName(d.join(dense, "b", "left_semi").groupBy("b", "r").agg(n))
    # a row for each number of rows up to PART, and one for each record of more: only those may have more items than PART
    counted = checkpointed(counted.groupBy(F.when(F.col("n") > PART, F.col("r")).alias("_r"), "n").agg(F.count("*").alias("records")))
    made, long = counted.agg(F.sum(F.when(F.col("_r").isNull(), pairs * F.col("records"))), F.count("_r")).first()
    few_pairs, many_pairs, many = int(made or 0), 0, d.select("r", F.col("i").alias("src"), F.col("i").alias("dst")).limit(0)
    if long:
        of_long = F.col("r") == F.col("_r")
        known = small_or_shuffled(counted.select("_r").where("_r IS NOT NULL"))
        items = d.join(known, of_long, "left_semi").repartition(tasks, "r", "i").distinct()
        sizes = checkpointed(items.groupBy(F.col("r").alias("_r")).agg(n))
        of_few, of_many = sizes.agg(F.sum(F.when(F.col("n") <= PART, pairs)), F.sum(F.when(F.col("n") > PART, pairs))).first()
        large = small_or_shuffled(sizes.where(F.col("n") > PART).select("_r", F.ceil(F.col("n") / PART).alias("parts")))
        few_pairs, many_pairs = few_pairs + int(of_few or 0), int(of_many or 0)
        d = d.join(known, of_long, "left_anti").unionByName(items.join(large, of_long, "left_anti"))
        many = _in_cells(items.join(large, of_long), cells.tasks(spark, many_pairs, TASK_PAIRS))
    few = d.repartition(max(tasks, cells.tasks(spark, few_pairs, TASK_PAIRS)), "b").groupBy("b", "r").agg(F.sort_array(F.collect_set("i")).alias("of"))
    few = few.where(F.size("of") > 1).select("b", "r", "of", F.posexplode("of").alias("at", "src")).select("b", "r", "src", F.explode(F.slice("of", F.col("at") + 2, PART)).alias("dst"))
    return few, many, few_pairs + many_pairs


def _in_cells(items: DataFrame, tasks: int) -> DataFrame:
    """(r, src, dst): pairs of the different ``items`` (r, i, parts) of records that are cut into ``parts`` by a hash."""
    d = items.withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts")))
    # every unordered pair of parts is a cell; a part belongs to as many cells as there are parts
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("x"), F.greatest("part", o).alias("y")))
    d = d.select("r", "i", "part", F.explode(cell).alias("cell")).repartition(tasks, "r", "cell")
    side = lambda part: F.collect_list(F.when(F.col("part") == F.col(part), F.col("i")))
    d = d.groupBy("r", "cell").agg(side("cell.x").alias("xs"), side("cell.y").alias("ys"))
    d = d.select("r", "cell", "ys", F.explode("xs").alias("x")).select("r", "cell", "x", F.explode("ys").alias("y")).where("cell.x < cell.y OR x < y")
    return d.select("r", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))


def paired(records: DataFrame, record: str, item: str) -> DataFrame:
    """(r, src, dst): unordered pairs of different items of each record, each once a record; null records pair nothing.

    A record of PART items or fewer is paired within its row, in partitions of about TASK_ROWS rows. Items of a larger one
    fall into parts by a hash, about PART in each, and parts meet in pairs of parts, so its pairs are spread over many tasks.
    """
    few, many, _ = _few_and_many(records, record, item)
    return few.drop("b").unionByName(many)


def cooccurrence(records: DataFrame, record: str, item: str) -> DataFrame:
    """(src, dst, weight): unordered pairs of different items and in how many records they stand together.

    Pairs are counted by the hashes of small records where they are made, so that a pair of very many records is sent as few
    rows, and then in partitions of about TASK_PAIRS pairs.
    """
    few, many, n = _few_and_many(records, record, item)
    made = few.groupBy("b", "src", "dst").agg(F.count("*").alias("weight")).drop("b").unionByName(many.select("src", "dst", F.lit(1).cast("long").alias("weight")))
    return made.repartition(cells.tasks(records.sparkSession, n, TASK_PAIRS), "src", "dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def guarded_relations(relations: DataFrame, records: DataFrame, record: str, item: str) -> DataFrame:
    """(subject, predicate, object): the relations as they are; only where there are none at all, one for each pair of items
    that stand in a record together."""
    if not relations.isEmpty():
        return relations.select("subject", "predicate", "object")
    return cooccurrence(records, record, item).select(F.col("src").alias("subject"), F.lit("共现").alias("predicate"), F.col("dst").alias("object"))


def by_weight(weight: Column) -> Column:
    """What an edge gives; none, whose weight is null, gives nothing."""
    return F.when(weight.isNull(), 0.0).otherwise(F.least(0.3 + 0.1 * weight, F.lit(0.8)))


def by_common(adamic_adar: Column) -> Column:
    return F.least(adamic_adar / 5, F.lit(0.6))


def _largest(direct: Column, common: Column, shared: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(direct, by_common(common), 0.7 * shared))


def scored(pairs: DataFrame, *others: str) -> DataFrame:
    """(src, dst, adamic_adar, shared, affinity) of pairs with ``weight``, ``adamic_adar`` and ``shared``, each null where
    there is none, and ``others``. What is missing counts as nothing: it is replaced before the limits, as ``least`` skips nulls."""
    common, shared = F.coalesce("adamic_adar", F.lit(0.0)), F.coalesce("shared", F.lit(0.0))
    return pairs.select("src", "dst", common.alias("adamic_adar"), shared.alias("shared"), _largest(by_weight(F.col("weight")), common, shared).alias("affinity"), *others)


def affinity(edges: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(src, dst, adamic_adar, shared, affinity) of pairs with an edge (weight), a common neighbour or a common document.

    Co-occurrence gives min(.3 + .1 w, .8); the sum of 1 / ln(degree) over common neighbours gives min(a / 5, .6); the
    documents (name, doc) that mention both, as a share of the smaller set, give .7 times that. The largest counts.

    The result holds all such pairs, so it grows with the square of a hub's neighbours: ``partners.affinity_of`` scores the
    pairs that are asked for, ``partners.best_partners`` finds the best of every entity, neither by way of all pairs.
    Pairs are summed up in cells of two blocks of names, and are neither shuffled nor joined.
    """
    e = checkpointed(both_ways(edges))
    degree = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).where("degree > 1")
    # what two names may meet in: a neighbour, a document; and edges
    members = e.join(degree, e["src"] == degree["id"]).select(F.lit(2).alias("kind"), F.col("src").cast("string").alias("id"), F.col("dst").alias("name"), (1 / F.ln("degree")).alias("worth"))
    sizes = e.select(F.col("src").alias("name"), F.lit(0).cast("long").alias("n")).limit(0)
    if documents is not None:
        m = checkpointed(documents.select("name", "doc").where("name IS NOT NULL AND doc IS NOT NULL").distinct())
        members = members.unionByName(m.select(F.lit(3).alias("kind"), F.col("doc").cast("string").alias("id"), "name", F.lit(1.0).alias("worth")))
        sizes = m.groupBy("name").agg(F.count("*").alias("n"))
    direct = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src != dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    edge = direct.select("src", "dst", F.greatest(by_weight(F.col("weight")), F.lit(0.0)).alias("direct"))
    d = cells.summed(checkpointed(members), checkpointed(edge), sizes)
    return d.select("src", "dst", F.col("common").alias("adamic_adar"), "shared", _largest(F.col("direct"), F.col("common"), F.col("shared")).alias("affinity"))


def set_overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller set's size."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def tree(nodes: DataFrame, root_is: Column) -> DataFrame:
    """(id, parent_id, title, depth, path, is_leaf) of an adjacency list (id, parent_id, title), level by level to the
    last one; a node that is its own ancestor is on no level and left out. A root's row is on level 0 alone, and a row of
    an id that stands above it ends its branch, so rows that repeat an id in a cycle come to an end."""
    nodes = nodes.select("id", "parent_id", "title", F.coalesce(root_is, F.lit(False)).alias("_root"))
    level = nodes.where("_root").select("id", "parent_id", "title", F.lit(0).alias("depth"), F.col("title").alias("path"), F.array("id").alias("_above"))
    out, d = level, 0
    while True:
        d += 1
        up = level.select(F.col("id").alias("up"), F.col("path").alias("up_path"), F.col("_above").alias("_up_above"))
        below = nodes.where(~F.col("_root")).join(up, nodes["parent_id"] == F.col("up")).where(~F.array_contains("_up_above", F.col("id")))
        level = below.select("id", "parent_id", "title", F.lit(d).alias("depth"), F.concat("up_path", F.lit("/"), "title").alias("path"), F.concat("_up_above", F.array("id")).alias("_above"))
        level = checkpointed(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    parents = nodes.select(F.col("parent_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("has_child", F.lit(True))
    return out.join(parents, "id", "left").select("id", "parent_id", "title", "depth", "path", F.col("has_child").isNull().alias("is_leaf"))


def descendants(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, distance): what edges (src, dst), followed forwards, reach from the roots (node) in ``depth`` steps or fewer."""
    e = checkpointed(edges.select("src", "dst").where("src != dst").distinct())
    seen = front = checkpointed(roots.select("node").distinct().withColumn("distance", F.lit(0)))
    for d in range(1, depth + 1):
        found = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        front = checkpointed(found.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def boosted(rows: DataFrame, key: str, score: str, held: DataFrame, affinities: DataFrame, asked: list) -> DataFrame:
    """``rows`` with ``boosted_score``: score x (1 + 0.3 x the largest affinity of an entity it holds to an asked one).

    ``held`` (key, entity) says which entities a row holds; ``affinities`` (src, dst, affinity) each pair once.
    """
    near = affinities.select("src", "dst", "affinity").union(affinities.select("dst", "src", "affinity")).where(F.col("src").isin(asked))
    best = held.join(near.groupBy(F.col("dst").alias("entity")).agg(F.max("affinity").alias("a")), "entity").groupBy(F.col(key).alias("_k")).agg(F.max("a").alias("_a"))
    d = rows.join(best, F.col(key) == F.col("_k"), "left").drop("_k")
    return d.withColumn("boosted_score", F.col(score) * (1 + 0.3 * F.coalesce("_a", F.lit(0.0)))).drop("_a")


def ranked_concepts(entities: DataFrame, edges: DataFrame, top: int = 50) -> DataFrame:
    """(name, mentions, connections, score, rank): score is mentions plus twice the connections."""
    ends = edges.select(F.col("src").alias("name")).union(edges.select("dst")).groupBy("name").agg(F.count("*").alias("connections"))
    d = entities.join(ends, "name", "left").select("name", "mentions", F.coalesce("connections", F.lit(0)).alias("connections"))
    d = d.withColumn("score", F.col("mentions") + 2 * F.col("connections")).orderBy(F.desc("score"), "name").limit(top)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "name")))
