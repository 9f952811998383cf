"""Event streams: tumbling, sliding and session windows with watermarks, the rate limiter, incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.tables import Scratch
from lodestone.operators.usage import Window


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks ask for."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = _timed(events, late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = _timed(events, late).groupBy(F.window("at", width, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = _timed(events, late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def usage(calls: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, model, calls and tokens of a stream of priced model calls (ts, model, prompt_tokens, output_tokens, cost_usd)."""
    w = _timed(calls, late).groupBy(F.window("at", width), "model")
    sums = w.agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))
    return sums.select(F.col("window.start").alias("start"), "model", "calls", "prompt_tokens", "output_tokens", "cost_usd")


def limiter(limit: int = 20, seconds: float = 60.0) -> Callable:
    """A stateful function of requests (user_id, event_id, at seconds, cost) for applyInPandasWithState: state is the live times."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = Window(limit, seconds, state.get[0] if state.exists else ())
        pdf = pd.concat(list(frames)).sort_values(["at", "event_id"], kind="stable")
        got = [w.ask(t, int(c)) for t, c in zip(pdf["at"], pdf["cost"])]
        state.update((list(w.times),))
        yield pd.DataFrame({"user_id": [key[0]] * len(pdf), "event_id": pdf["event_id"].to_numpy(), "allowed": [a for a, _ in got]})

    return run


def limited(requests: DataFrame, limit: int = 20, seconds: float = 60.0) -> DataFrame:
    return requests.groupBy("user_id").applyInPandasWithState(limiter(limit, seconds), "user_id long, event_id long, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def upserting(store, table: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of a stream becomes a version of the store's table, last rows by key winning."""
    from lodestone.operators.registry import upsert

    def batch(df: DataFrame, epoch: int) -> None:
        old = store.read(table)
        store.commit({table: df.dropDuplicates(keys) if old is None else upsert(old, df.dropDuplicates(keys), keys)})

    return batch


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now, into a table in memory (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


#: Which store holds a stream's state, and the one that keeps it on disk.
_STATES, _ON_DISK = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stored(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now, into a written table: results of any size, none of them on the driver.

    Complete: the last batch's result; append: all batches' rows. The state is on the executors' disks (unless the session
    names a store), its versions and the results are in the shared folder.
    """
    spark, scratch = stream.sparkSession, Scratch(stream.sparkSession)
    held: list[DataFrame] = []

    def batch(df: DataFrame, epoch: int) -> None:
        held.append(scratch.write(df, "stream"))
        while mode == "complete" and len(held) > 1:
            scratch.drop(held.pop(0))

    with scratch.folder("state") as state:
        writer = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        named = spark.conf.get(_STATES, None)
        if not named:
            spark.conf.set(_STATES, _ON_DISK)
        try:
            q = writer.start()
        finally:
            if not named:
                spark.conf.unset(_STATES)
        q.awaitTermination()
    return reduce(DataFrame.unionByName, held) if held else spark.createDataFrame([], stream.schema)
