"""Numbers and neighbours of ordered rows, however many rows a group has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only after its rows have been counted and are no more than this.
BROADCAST_ROWS = 100_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one on a local master (tests);
    elsewhere an error, as executors could not share such a folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the session's checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own below the checkpoint folder, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def on_all(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of several columns; true for none."""
    return reduce(Column.__and__, [a.eqNullSafe(b) for a, b in zip(left, right, strict=True)], F.lit(True))


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "n") -> DataFrame:
    """``rows`` with their number from 1 within their group, as ``row_number`` gives it; checkpointed.

    Rows are sorted in range partitions and numbered by offsets, so that a group of any size never meets in one task.
    """
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    d = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    d = checkpointed(d).withColumn("_run", F.shiftright("_at", 33))  # the partition's number
    runs = d.groupBy(*group, "_run").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start") + 1
    runs = checkpointed(runs.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_run").alias("_r"), shift.alias("_shift")))
    same = on_all([F.col(g) for g in group], [F.col(f"_g{i}") for i in range(len(group))]) & (F.col("_run") == F.col("_r"))
    return d.join(small_or_shuffled(runs), same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_at") + F.col("_shift")).alias(name))


def with_previous(rows: DataFrame, group: list[str], number: str, columns: list[str], back: int = 1) -> DataFrame:
    """``rows`` with ``<column>_1`` ... of the rows one to ``back`` before, by ``number`` within the group; null where none."""
    out = rows
    for k in range(1, back + 1):
        side = rows.select(*[F.col(g).alias(f"_p{i}") for i, g in enumerate(group)], (F.col(number) + k).alias("_pn"), *[F.col(c).alias(f"{c}_{k}") for c in columns])
        same = on_all([F.col(g) for g in group], [F.col(f"_p{i}") for i in range(len(group))]) & (F.col(number) == F.col("_pn"))
        out = out.join(side, same, "left").drop(*[f"_p{i}" for i in range(len(group))], "_pn")
    return out
