"""Communities of a weighted graph by modularity (Blondel et al., J. Stat. Mech. 2008), as rounds of joins and groupings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ordering import BROADCAST_ROWS, checkpoint_folder, checkpointed, removed

#: A gain in modularity below this is none: it is left to rounding.
LEAST_GAIN = 1e-9


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, weight), each edge from both ends and a loop once with twice its weight, so that a node's weights add up to
    its degree. Repeated edges add up; edges with a null end, or a weight that is null or not above zero, count for nothing."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0")
    both = e.where("src <> dst").select(F.explode(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))).alias("e")).select("e.*")
    loops = e.where("src = dst").select("src", "dst", (2 * F.col("weight")).alias("weight"))
    return both.unionByName(loops).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, ``modularity``: the share of the edges' weight (src, dst, weight) inside ``communities`` (node, community),
    less what degrees alone would put there. Null for a graph without edges; nodes without a community are left out."""
    e = undirected(edges)
    c = communities.select("node", "community")
    near = e.join(c.withColumnsRenamed({"node": "src", "community": "c_src"}), "src").join(c.withColumnsRenamed({"node": "dst", "community": "c_dst"}), "dst")
    sums = near.groupBy(F.col("c_src").alias("c")).agg(F.sum("weight").alias("degrees"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0)).alias("inside"))
    d = sums.agg(F.sum("degrees").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("degrees") * F.col("degrees")).alias("squares"))
    return d.select((F.col("inside") / F.col("all") - resolution * F.col("squares") / F.col("all") / F.col("all")).alias("modularity"))


class _Folder:
    """Tables written below the checkpoint folder and read again. A checkpoint would keep the optimizer's guess of its size,
    a product of its inputs' sizes that gains digits with every round of joins; files have the size they have."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{checkpoint_folder(spark)}/communities_{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")


class _Level:
    """One level's graph: edges from both ends without loops, and what each node weighs.

    Edges lie in order of their first end, so that what a node has in a community is summed up before it is shuffled, and
    are read twice a round. Nothing of their number is written: what a round keeps has a row for each node or community.
    """

    def __init__(self, edges: DataFrame, resolution: float, folder: _Folder):
        self.folder = folder
        e = folder.written(edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst"))
        self.edges = e.where("src <> dst")
        sums = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("loop"))
        labels = folder.written(sums.select("node", "degree", "loop", F.col("node").alias("community")))
        found = labels.agg(F.sum("degree").alias("all"), F.count("*").alias("nodes")).first()
        self.all, self.few = found["all"] or 0.0, found["nodes"] <= BROADCAST_ROWS
        self.resolution = resolution
        self.look(labels)

    def near(self, df: DataFrame) -> DataFrame:
        """``df``, of a row for each node or community, to be broadcast where they are few."""
        return F.broadcast(df) if self.few else df

    def look(self, labels: DataFrame) -> None:
        """Takes ``labels`` as the state: how much each node has in its own community, and the modularity."""
        ends = [self.near(labels.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))) for end in ("src", "dst")]
        own = self.edges.join(ends[0], "src").join(ends[1], "dst").where("c_src = c_dst").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w"))
        self.labels = self.folder.written(labels.select("node", "degree", "loop", "community").join(own, "node", "left"))
        sums = self.labels.groupBy("community").agg(F.sum("degree").alias("degrees"), F.sum("loop").alias("inside"), F.sum("w").alias("w"), F.count("*").alias("nodes"))
        self.degrees = self.folder.written(sums)
        share = (F.col("inside") + F.coalesce("w", F.lit(0.0))) / self.all - self.resolution * F.col("degrees") * F.col("degrees") / self.all / self.all
        self.modularity = self.degrees.agg(F.sum(share)).first()[0] or 0.0

    def state(self) -> tuple[DataFrame, DataFrame, float]:
        return self.labels, self.degrees, self.modularity

    def back_to(self, state: tuple[DataFrame, DataFrame, float]) -> None:
        self.labels, self.degrees, self.modularity = state

    def moves(self) -> DataFrame:
        """(node, community, target, gain): for each node the community that gains most, if any does; the smallest of equals."""
        d, lone = self.degrees.select("community", "degrees", "nodes"), self.resolution / self.all
        stay = F.coalesce("w", F.lit(0.0)) - lone * F.col("degree") * (F.col("degrees") - F.col("degree"))
        own = self.labels.join(self.near(d), "community").select("node", "degree", F.col("community").alias("own"), F.col("nodes").alias("own_nodes"), stay.alias("stay"))
        around = self.edges.join(self.near(self.labels.select(F.col("node").alias("dst"), "community")), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
        there = around.join(self.near(d), "community").join(self.near(own), "node").where("community <> own")
        # of two nodes on their own only the larger moves to the smaller
        there = there.where("nodes > 1 OR own_nodes > 1 OR community < own")
        gain = F.round(2 * (F.col("w") - lone * F.col("degree") * F.col("degrees") - F.col("stay")) / self.all, 15)
        there = there.select("node", "own", F.col("community").alias("target"), gain.alias("gain")).where(F.col("gain") > LEAST_GAIN)
        best = there.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("minus"), "target", "own")).alias("b"))
        return best.select("node", F.col("b.own").alias("community"), F.col("b.target").alias("target"), (-F.col("b.minus")).alias("gain"))

    def moved(self, moves: DataFrame) -> DataFrame:
        m = moves.select("node", "target")
        return self.folder.written(self.labels.join(m, "node", "left").select("node", "degree", "loop", F.coalesce("target", "community").alias("community")))


def _apart(moves: DataFrame) -> DataFrame:
    """Of ``moves`` those that are best for both communities they touch, so that no community takes part in two: their gains
    then add up exactly. At least the best move of all is among them."""
    ends = moves.select("node", "gain", F.explode(F.array("community", "target")).alias("c"))
    best = ends.groupBy("c").agg(F.min(F.struct((-F.col("gain")).alias("minus"), "node")).alias("b")).select(F.col("b.node").alias("node"))
    return moves.join(best.groupBy("node").agg(F.count("*").alias("n")).where("n = 2").select("node"), "node")


def louvain(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, least_gain: float = 1e-4, rounds: int = 1000) -> DataFrame:
    """(node, community) of a weighted graph (src, dst, weight); a community is named by its smallest node.

    Levels of local moves: nodes join the neighbouring community that raises modularity most, until a round raises it by
    less than ``least_gain``; communities then become the nodes of the next level, until a level moves nothing. All
    nodes of a changing half move at once where that raises modularity; otherwise only moves that touch no community in
    common do, whose gains add up. So modularity rises in every round, nothing can swap for ever, and the result does
    not hang on the order of rows. ``rounds`` bounds each level; what is reached by then counts.

    ``nodes`` (node) may name more nodes; those without edges keep to themselves, as all do in a graph without edges. A
    node's row holds its own numbers only: neighbours meet by grouping, never in one row, whatever the degree.
    """
    folder = _Folder(edges.sparkSession)
    try:
        return checkpointed(_louvain(edges, nodes, resolution, least_gain, rounds, folder))
    finally:
        removed(edges.sparkSession, folder.path)


def _louvain(edges: DataFrame, nodes: DataFrame | None, resolution: float, least_gain: float, rounds: int, folder: _Folder) -> DataFrame:
    level = _Level(undirected(edges), resolution, folder)
    places = level.labels.select("node", "community")
    while level.all:
        began, quiet = level.modularity, 0
        for r in range(rounds):
            before = level.modularity
            moves = folder.written(level.moves())
            if moves.isEmpty():
                break
            state = level.state()
            half = moves.where(F.pmod(F.xxhash64(F.col("node"), F.lit(r)), F.lit(2)) == 0)
            level.look(level.moved(half))
            if level.modularity <= before + LEAST_GAIN:
                level.back_to(state)
                level.look(level.moved(_apart(moves)))
            quiet = quiet + 1 if level.modularity < before + least_gain else 0
            if quiet == 2:  # both halves had a turn
                break
        found = level.labels.select(F.col("node").alias("n"), F.col("community").alias("c"))
        if r == 0 and level.modularity == began:
            break
        places = folder.written(places.join(found, F.col("community") == F.col("n")).select("node", F.col("c").alias("community")))
        if level.modularity < began + least_gain:
            break
        ends = [found.select(F.col("n").alias(end), F.col("c").alias(f"c_{end}")) for end in ("src", "dst")]
        loops = level.labels.where("loop > 0").select(F.col("community").alias("src"), F.col("community").alias("dst"), F.col("loop").alias("weight"))
        joined = level.edges.join(ends[0], "src").join(ends[1], "dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"), "weight")
        level = _Level(joined.unionByName(loops).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), resolution, folder)
    least = places.groupBy(F.col("community").alias("c")).agg(F.min("node").alias("community"))
    out = places.select("node", F.col("community").alias("c")).join(least, "c").select("node", "community")
    if nodes is not None:
        rest = nodes.select("node").where("node IS NOT NULL").distinct().join(out.select("node"), "node", "left_anti")
        out = out.unionByName(rest.select("node", F.col("node").alias("community")))
    return out
