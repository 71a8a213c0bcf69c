"""Streams (T1-T9, P2, W16, K1, A20): drop logs, running totals, agent runs, windows. Each transformation is that of the batch twin."""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.operators.audit import GENESIS, chained


def drops(lines: DataFrame) -> DataFrame:
    """Ts, proto, dst, dport of the lines that record a dropped packet that was to be sent."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#"))).select(f.alias("f"))
    rows = rows.where((F.size("f") >= 8) & (F.get("f", F.lit(2)) == "DROP") & (F.element_at("f", -1) != "RECEIVE"))
    g = lambda i: F.get("f", F.lit(i))
    return rows.select(F.concat_ws(" ", g(0), g(1)).alias("ts"), g(3).alias("proto"), g(5).alias("dst"), g(7).alias("dport"))


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder; the checkpoint takes the place of the offset, a rotated log is a new file, and lines are whole."""
    return spark.readStream.format("text").load(folder)


def running_total(dropped: DataFrame) -> DataFrame:
    """T4, W16"""
    return dropped.groupBy().agg(F.count(F.lit(1)).alias("total"))


def newest(dropped: DataFrame, n: int = 40) -> DataFrame:
    """T8"""
    return dropped.orderBy(F.desc("ts"), "dst", "dport").limit(n)


def tumbling(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """T9, an extension: count and sum of each window and type; batch or stream (a watermark takes a timestamp with zone)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("decimal(18,4)").cast("double").alias("total"))


def run_states(events: DataFrame, step_cap: int = 12, token_cap: int = 6000) -> DataFrame:
    """run_id, steps, tokens, status of a run so far; state is two numbers and a status for each run."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, tokens, status = state.get if state.exists else (0, 0, "running")
        # a run's events of one trigger come in parts; a run has at most some hundred
        for kind, spent in pd.concat(list(batches)).sort_values("n", kind="stable")[["kind", "tokens"]].itertuples(index=False):
            if status != "running":
                break
            steps += kind == "step"
            tokens += int(spent)
            if kind in ("final", "halted", "killed"):
                status = kind
            elif steps >= step_cap or tokens >= token_cap:
                status = "halted"
        state.update((int(steps), int(tokens), status))
        yield pd.DataFrame({"run_id": [key[0]], "steps": [int(steps)], "tokens": [int(tokens)], "status": [status]})

    return events.groupBy("run_id").applyInPandasWithState(update, "run_id string, steps long, tokens long, status string", "steps long, tokens long, status string", "update", "NoTimeout")


def pushed(dropped: DataFrame, push: Callable[[dict], None], log: Callable[[], DataFrame] | None = None, seconds: int = 1, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """T5: each trigger pushes the new drops (newest first, ``newest`` of them), the running total, and the last 15 lines of the log.

    The total is kept by batch, so a batch that is replayed doesn't count twice.
    """
    totals: dict[int, int] = {}

    def send(batch: DataFrame, number: int) -> None:
        totals[number] = batch.count()
        tail = [r["value"] for r in log().orderBy(F.desc("line_no")).limit(15).collect()][::-1] if log else []
        push({"drops": [r.asDict() for r in newest(batch).collect()], "total": sum(totals.values()), "audit": tail})

    out = dropped.writeStream.foreachBatch(send)
    out = out.option("checkpointLocation", checkpoint) if checkpoint else out
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{seconds} second")).start()


def append_chain(path: str, query: str = ""):
    """A foreachBatch sink that continues a hash chain in one file of one writer.

    Beside the file stands its state: the last batch of each query (one with a new checkpoint needs a new name), the file's size after it, and the last line's number and hash; nothing of the log is
    read again. A batch that is replayed is left out. Lines of a batch that broke off are cut away before it is written anew; a size that
    is neither means that another writer has been there, which is an error.
    """

    def load() -> dict:
        if os.path.exists(path + ".state"):
            with open(path + ".state", encoding="utf-8") as f:
                return json.load(f)
        if not os.path.exists(path) or not os.path.getsize(path):
            return {"batches": {}, "size": 0, "seq": -1, "hash": GENESIS, "writing": False}
        with open(path, "rb") as f:
            last = json.loads(deque((x for x in f if x.strip()), 1)[0])
        return {"batches": {}, "size": os.path.getsize(path), "seq": last["seq"], "hash": last["hash"], "writing": False}

    def save(state: dict) -> None:
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(state, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".new", path + ".state")

    save(load())

    def sink(batch: DataFrame, number: int) -> None:
        state = load()
        size = os.path.getsize(path) if os.path.exists(path) else 0
        if size != state["size"] and not (state["writing"] and size > state["size"]):
            raise RuntimeError("another writer has appended to the log")
        if number <= state["batches"].get(query, -1):
            return
        save({**state, "writing": True})
        with open(path, "ab") as f:
            f.truncate(state["size"])
            records = (json.loads(r["value"]) for r in batch.toLocalIterator())
            for line in chained(records, state["hash"], state["seq"] + 1):
                f.write(line.encode() + b"\n")
                last = json.loads(line)
                state = {**state, "seq": last["seq"], "hash": last["hash"]}
            f.flush()
            os.fsync(f.fileno())
            size = f.tell()
        save({**state, "batches": {**state["batches"], query: number}, "size": size, "writing": False})

    return sink
