"""A stream of steps gives the rows of the batch operators, however it is cut, and after a restart; idle sessions end."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docloom.operators import conversation
from docloom.streaming import session_state

COLUMNS = {"session": "user", "step": "n", "tool": "tool", "item": "item"}
SCHEMA = "user long, n long, tool string, item string, hits int, ts timestamp"


def columns():
    return COLUMNS | {"empty": F.col("hits") == 0}


def log_rows(seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for n in range(400):
        user = rng.choice([1, 1, 1, 2, 3])
        rows.append((user, n, rng.choice(["grep", "grep", "read", "list", None]), rng.choice([None, *"abcdefgh"]) if n < 250 else rng.choice("ab"), rng.choice([0, 0, 5]), f"2024-01-01 00:{n // 60:02}:{n % 60:02}"))
    return rows


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))


def expected(d) -> list[tuple]:
    gain = conversation.information_gain(d, "user", "n", "item")
    stuck = conversation.stuck(d, "user", "n", "tool")
    empty = conversation.empty_streaks(d, "user", "n", F.col("hits") == 0).withColumn("empty_run", F.lit(True))
    j = gain.join(stuck, ["user", "n"]).join(empty, ["user", "n"], "left")
    return sorted((r.user, r.n, r.gain, r.saturated, r.run_length, r.in_recent or 0, bool(r.is_stuck), bool(r.empty_run)) for r in j.collect())


def got(d) -> list[tuple]:
    return sorted((r.user, r.step, r.gain, r.saturated, r.run_length, r.in_recent, r.is_stuck, r.empty_run) for r in d.collect())


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows, rng = log_rows(1), random.Random(2)
    cuts = [0, *sorted(rng.sample(range(1, 400), 4)), 400]
    source, where = f"{tmp_path}/in", f"{tmp_path}/work"
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = rows[a:b]
        rng.shuffle(part)
        if k == 3:
            part += rows[a - 5 : a]  # sent again
        table_of(spark, part).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 4):  # the query ends and starts anew with what it has kept
            found = session_state.steps_of_table(spark, source, SCHEMA, where, **columns())
            assert got(found) == expected(table_of(spark, rows[:b]))
    everything = got(found)
    assert {r[3] for r in everything} == {True, False} and {r[6] for r in everything} == {True, False} and {r[7] for r in everything} == {True, False}


def test_idle_sessions_are_forgotten(spark, tmp_path):
    rows = [(1, 1, "t", "a", 1, "2024-01-01 00:00:00"), (1, 2, "t", "a", 1, "2024-01-01 00:01:00"), (2, 3, "t", "a", 1, "2024-01-01 06:00:00"), (2, 4, "t", "a", 1, "2024-01-01 06:01:00"), (1, 5, "t", "a", 1, "2024-01-01 06:02:00"), (None, 6, "t", "a", 1, "2024-01-01 06:02:00"), (1, None, "t", "a", 1, "2024-01-01 06:02:00")]
    for part in (rows[:2], rows[2:3], rows[3:4], rows[4:]):
        table_of(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = session_state.steps_of_table(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/work", late="1 minute", idle_ms=3_600_000, **columns())
    assert [(r.user, r.step, r.gain, r.run_length) for r in found.orderBy("step").collect()] == [(1, 1, 1, 1), (1, 2, 0, 2), (2, 3, 1, 1), (2, 4, 0, 2), (1, 5, 1, 1)]
