"""Exact quantiles by narrowing ranges: no task holds the values of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.ordering import checkpointed

#: A range of at most so many rows is sorted by one task.
RANGE_ROWS = 200_000
#: A sketch gives the values at so many equal steps; its ranks are off by a tenth of a step at most.
STEPS = 1000


def _sketch(value: Column) -> Column:
    return F.percentile_approx(value, [i / STEPS for i in range(STEPS + 1)], 10 * STEPS)


def _between(value: Column) -> Column:
    """Strictly inside a target's range, whose ends may be open."""
    return (F.col("low").isNull() | (value > F.col("low"))) & (F.col("high").isNull() | (value < F.col("high")))


def _narrowed(values: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (_g, rank, low, high, below, inside, splits) after a pass over the values strictly inside their ranges.

    The splits on both sides of a target's rank cut its range in five: what is less than the lower one, equal to it,
    between both, equal to the upper one, greater. Counts tell which holds the rank, so a result never hangs on the
    sketch being right; equal values are never in a range again, so each pass leaves some hundredths of it.
    """
    at = (F.col("rank") - F.col("below")) / F.greatest(F.col("inside") - 1, F.lit(1)) * (F.size("splits") - 1)
    t = targets.withColumn("a", F.get("splits", F.greatest(F.floor(at) - 1, F.lit(0)).cast("int")))
    t = t.withColumn("b", F.get("splits", F.least(F.ceil(at) + 1, F.size("splits") - 1).cast("int")))
    v = F.col("_v")
    d = values.join(F.broadcast(t), F.col("_vg").eqNullSafe(F.col("_g"))).where(_between(v))
    middle = (v > F.col("a")) & (v < F.col("b"))
    c = d.groupBy(F.col("_g").alias("c_g"), F.col("rank").alias("c_rank")).agg(
        F.count_if(v < F.col("a")).alias("less"),
        F.count_if(v == F.col("a")).alias("at_a"),
        F.count_if(middle).alias("middle"),
        F.count_if((v == F.col("b")) & (F.col("a") < F.col("b"))).alias("at_b"),
        F.count_if(v > F.col("b")).alias("more"),
        _sketch(F.when(middle, v)).alias("next"),
    )
    t = t.join(F.broadcast(c), F.col("_g").eqNullSafe(F.col("c_g")) & (F.col("rank") == F.col("c_rank")))
    r = F.col("rank") - F.col("below")
    ends = [F.col("less")]
    for name in ("at_a", "middle", "at_b"):
        ends.append(ends[-1] + F.col(name))

    def case(less, a, middle, b, more):
        return F.when(r < ends[0], less).when(r < ends[1], a).when(r < ends[2], middle).when(r < ends[3], b).otherwise(more)

    a, b, none = F.col("a"), F.col("b"), F.lit(None)
    return t.select(
        "_g",
        "rank",
        case(F.col("low"), none, a, none, b).alias("low"),
        case(a, none, b, none, F.col("high")).alias("high"),
        (F.col("below") + case(F.lit(0), F.lit(0), ends[1], F.lit(0), ends[3])).alias("below"),
        case(F.col("less"), none, F.col("middle"), none, F.col("more")).alias("inside"),
        case(F.filter("splits", lambda x: x < a), none, F.col("next"), none, F.filter("splits", lambda x: x > b)).alias("splits"),
        case(none, a, none, b, none).alias("found"),
    )


def exact_quantiles(rows: DataFrame, group: str, value: str, quantiles: list[float], most: int = RANGE_ROWS) -> DataFrame:
    """(group, quantile, value): exact quantiles of each group's numbers, between two ranks the share of both.

    Nulls count for nothing, a group of nulls has no row, and NaN is the greatest number. A first pass counts and
    sketches each group; every further one counts what lies on both sides of two values near the rank that is sought,
    and sketches what lies between, until ``most`` rows are left, which are sorted. What a task holds is a sketch and a few
    counts for each group and quantile; groups are few, like the columns of a table.
    """
    v = rows.select(F.col(group).alias("_vg"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    totals = checkpointed(v.groupBy(F.col("_vg").alias("_g")).agg(F.count("*").alias("n"), _sketch(F.nanvl("_v", F.lit(float("inf")))).alias("splits")))
    asked = totals.select("_g", "n", "splits", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")).withColumn("position", (F.col("n") - 1) * F.col("q"))
    asked = asked.withColumn("from", F.floor("position")).withColumn("to", F.ceil("position"))
    unknown = F.lit(None).cast("double")
    start = asked.select("_g", F.explode(F.array("from", "to")).alias("rank"), unknown.alias("low"), unknown.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "splits", unknown.alias("found"))
    open_ = start.dropDuplicates(["_g", "rank"])
    done = []
    while True:
        wide = checkpointed(open_.where((F.col("inside") > most) & (F.size("splits") > 0)))
        done.append(open_.where("found IS NOT NULL OR inside <= {} OR size(splits) <= 0".format(most)).select("_g", "rank", "low", "high", "below", "found"))
        if wide.isEmpty():
            break
        open_ = checkpointed(_narrowed(v, wide))
    ends = checkpointed(reduce(DataFrame.union, done))
    left = ends.where("found IS NULL").drop("found")
    near = v.join(F.broadcast(left), F.col("_vg").eqNullSafe(F.col("_g"))).where(_between(F.col("_v"))).groupBy("_g", "rank", "below", "_v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_g", "rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto + F.col("below")).where("rank < upto AND rank >= upto - n").select("_g", "rank", F.col("_v").alias("found"))
    found = checkpointed(ends.where("found IS NOT NULL").select("_g", "rank", "found").union(near))
    low, high = found.toDF("l_g", "l_rank", "l"), found.toDF("h_g", "h_rank", "h")
    d = asked.join(F.broadcast(low), F.col("_g").eqNullSafe(F.col("l_g")) & (F.col("from") == F.col("l_rank"))).join(F.broadcast(high), F.col("_g").eqNullSafe(F.col("h_g")) & (F.col("to") == F.col("h_rank")))
    share = (F.col("to") - F.col("position")) * F.col("l") + (F.col("position") - F.col("from")) * F.col("h")
    return d.select(F.col("_g").alias(group), F.col("q").alias("quantile"), F.when(F.col("from") == F.col("to"), F.col("l")).otherwise(share).alias("value"))
