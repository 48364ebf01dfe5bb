"""State of sessions on a stream: information gain, repeated calls and empty results, as steps arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "gain int, saturated boolean, run_length int, in_recent int, is_stuck boolean, empty_run boolean"


class SessionSteps(StatefulProcessor):
    """What a session's next step needs to know of those before it.

    Two states a session: the items it has seen, a key each, and one short row with the last gains, the last tools, the
    length of the present run and of the run of empty results. A timer at the last step's time plus ``idle`` clears both
    once the watermark has passed it.
    """

    def __init__(self, session: str, session_type: str, step_type: str, window: int, streak: int, often: int, recent: int, empties: int, idle_ms: int):
        self.session, self.session_type, self.step_type = session, session_type, step_type
        self.window, self.streak, self.often, self.recent, self.empties, self.idle_ms = window, streak, often, recent, empties, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "item string", "since string")
        self.last = handle.getValueState("last", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["step", "item", "tool"], kind="stable")
        state = json.loads(self.last.get()[0]) if self.last.exists() else {"step": None, "gains": [], "tools": [], "run": 0, "empty": 0, "until": 0}
        out, fresh = [], {}
        for step, tool, item, empty, ms in zip(d["step"], d["tool"], d["item"], d["empty"], d["ms"], strict=True):
            step = int(step)
            if state["step"] is not None and step <= state["step"]:
                continue  # has been counted
            tool, item = (None if pd.isna(x) else str(x) for x in (tool, item))
            name = json.dumps(item)
            if name not in fresh:
                fresh[name] = not self.seen.containsKey((name,))
            gain, fresh[name] = int(fresh[name]), False
            if gain:
                self.seen.updateValue((name,), (str(step),))
            gains, tools = [*state["gains"], gain], [*state["tools"], tool]
            run = state["run"] + 1 if tool is not None and state["tools"][-1:] == [tool] else 1
            empty_run = state["empty"] + 1 if empty else 0
            in_recent = sum(t == tool for t in tools[-self.recent :]) if tool is not None else 0
            out.append((key[0], step, gain, len(gains) >= self.window and not any(gains[-self.window :]), run, in_recent, run >= self.streak or in_recent >= self.often, empty_run >= self.empties))
            state = {"step": step, "gains": gains[-self.window + 1 :], "tools": tools[-self.recent + 1 :], "run": run, "empty": empty_run, "until": max(state["until"], int(ms) + self.idle_ms)}
        if out:
            self.last.update((json.dumps(state),))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(state["until"])
        names = [self.session, "step", "gain", "saturated", "run_length", "in_recent", "is_stuck", "empty_run"]
        yield pd.DataFrame(out, columns=names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.last.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def session_steps(log: DataFrame, session: str, step: str, tool: str, item: str, empty: Column, ts: str = "ts", window: int = 5, streak: int = 5, often: int = 5, recent: int = 11, empties: int = 3, late: str = "1 hour", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """(session, step, gain, saturated, run_length, in_recent, is_stuck, empty_run) for each step of a stream of calls, with
    the meaning that ``conversation.information_gain``, ``stuck`` and ``empty_streaks`` give them over a whole table.

    A session's steps come in order from one micro-batch to the next; within a batch their order is free. A step up to the
    last one counted, as after a source sent rows again, is left out, and so are null sessions and steps. Rows later than
    the watermark are dropped. A session that rests for ``idle_ms`` before the watermark is forgotten: what comes after
    begins anew. State grows with a session's different items and no further.
    """
    spark = log.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.col(ts).cast("timestamp")
    d = log.select(F.col(session), F.col(step).cast("long").alias("step"), F.col(tool).cast("string").alias("tool"), F.col(item).cast("string").alias("item"), F.coalesce(empty, F.lit(False)).alias("empty"), at.alias("_at"), F.unix_millis(at).alias("ms"))
    d = d.where(F.col(session).isNotNull() & F.col("step").isNotNull() & F.col("_at").isNotNull()).withWatermark("_at", late)
    kinds = d.schema[session].dataType.simpleString(), "long"
    processor = SessionSteps(session, *kinds, window, streak, often, recent, empties, idle_ms)
    return d.groupBy(session).transformWithStateInPandas(processor, f"`{session}` {kinds[0]}, step long, {OUT}", "append", "EventTime")


def write_steps(steps: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes what there is, adds it to the Parquet table ``out`` and ends; started again with the same
    ``checkpoint`` it goes on from there with its state."""
    return steps.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def steps_of_table(spark: SparkSession, path: str, schema, folder: str, files: int = 1, **columns) -> DataFrame:
    """``session_steps`` of the Parquet files at ``path``, read as a stream of ``files`` a batch through to its end."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    write_steps(session_steps(log, **columns), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")
