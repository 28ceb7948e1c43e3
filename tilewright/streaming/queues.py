"""Structured Streaming over work items and events."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilewright.session import scratch_path, written


def drain(stream: DataFrame, name: str, mode: str = "append", out: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now into Parquet in the shared folder (at ``out``, if it is given), and reads that."""
    state = scratch_path(stream.sparkSession, f"{name}-state")
    out = out or scratch_path(stream.sparkSession, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at a path (a file or a folder) as a stream of its files."""
    # as a pattern, since a stream takes a plain path for a folder's
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed_counts(events: DataFrame, ts: str, keys: list[str], length: str, late: str) -> DataFrame:
    """Counts of tumbling windows; rows later than ``late`` are left out, and a window is given when it is closed."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_requests(requests: DataFrame, ts: str, keys: list[str], within: str) -> DataFrame:
    """Each requested key once for as long as it is remembered."""
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within)
    return timed.dropDuplicatesWithinWatermark(keys)


def bounded_retries(attempts: DataFrame, key: str, number: str, ok: str, most: int = 3, ts: str | None = None, remember: str = "30 days") -> DataFrame:
    """Outcomes of work items from a stream of attempts (key, number, ok).

    The attempts of a key are taken by their number. A good one ends the item as ``done``; the
    ``most``-th bad one in a row ends it as ``dead``. Then the key starts anew. Each row says with how
    many attempts the item ended. A null ``ok`` is a bad attempt; attempts of a null key are left out.
    Only keys with an open item have a state. With the time ``ts`` of attempts an open item is forgotten
    where the next attempt comes over ``remember`` after its last one, and its state ends when the stream's time,
    ``remember`` behind the latest attempt, has got there; attempts of a null time or before the
    stream's time are then left out.
    """

    def follow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (tried, until), out = state.get if state.exists else (0, 0), []
        rows = pd.concat(list(batches)).sort_values("_number")
        for good, at, next_until in zip(rows["_ok"], rows["_at"], rows["_until"]):
            tried = tried + 1 if at <= until else 1
            until = max(until, next_until) if tried > 1 else next_until
            if good or tried >= most:
                out.append((k[0], "done" if good else "dead", tried))
                tried, until = 0, 0
        if tried:
            state.update((int(tried), int(until)))
            if ts is not None:
                state.setTimeoutTimestamp(max(int(until), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["_key", "outcome", "attempts"])

    c = F.col
    held, timeout = attempts.where(c(key).isNotNull()), GroupStateTimeout.NoTimeout
    columns = [c(key).alias("_key"), c(number).alias("_number"), F.coalesce(ok, F.lit(False)).alias("_ok")]
    if ts is None:
        held = held.select(*columns, F.lit(0).cast("bigint").alias("_at"), F.lit(0).cast("bigint").alias("_until"))
    else:
        time = c(ts).cast("timestamp")
        until = F.unix_millis(time + F.expr(f"INTERVAL {remember}"))
        held = held.select(*columns, F.unix_millis(time).alias("_at"), until.alias("_until"), time.alias("_ts")).where("_ts IS NOT NULL").withWatermark("_ts", remember)
        timeout = GroupStateTimeout.EventTimeTimeout
    kind = attempts.schema[key].dataType.simpleString()
    out = held.groupBy("_key").applyInPandasWithState(follow, f"_key {kind}, outcome string, attempts int", "tried int, until long", "append", timeout)
    return out.withColumnRenamed("_key", key)


def with_second_run(requests: DataFrame, work) -> DataFrame:
    """request, run, state: requests that ``work`` leaves incomplete are written down, and run once more.

    ``work(requests, run)`` adds ``complete``. What is incomplete after the second run stays so.
    """
    first = written(work(requests, 1), "first-run")
    second = work(first.where("NOT complete").drop("complete"), 2)
    out = first.where("complete").withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.when(F.col("complete"), F.lit(2))))
    return out.select("request", "run", F.when(F.col("complete"), "done").otherwise("incomplete").alias("state"))


class Counts(StreamingQueryListener):
    """Rows taken and given by each named stream so far, as its batches report them."""

    def __init__(self) -> None:
        self._batches, self._ended, self._changed = {}, set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = [p.observedMetrics.get(m) for m in ("taken", "given")]
        if all(found):
            with self._changed:  # a batch that is run again counts once
                self._batches[p.name, p.batchId] = tuple(int(row["n"]) for row in found)

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def of(self, name: str) -> tuple[int, int]:
        """Rows that the stream of this name has taken and given."""
        with self._changed:
            each = [n for (who, _), n in self._batches.items() if who == name]
        return sum(n[0] for n in each), sum(n[1] for n in each)

    def await_end(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Waits until the end of a query has been reported, after which all of its batches have."""
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError(f"no report of the end of {query.name}")


def counted(stream: DataFrame, stage) -> DataFrame:
    """What a stage gives of a stream, with the rows that it takes and gives reported for ``Counts``."""
    n = F.count(F.lit(1)).alias("n")
    return stage(stream.observe("taken", n)).observe("given", n)


def chained(stream: DataFrame, stages: list[tuple[str, object]]) -> tuple[dict[str, DataFrame], dict[str, tuple[int, int]]]:
    """What each stage of a chain gave, and how many rows it took and gave: a stage is a function of the stream that the one before it writes.

    All stages run at once: the first takes what is there now, and each other one takes what the one before
    has committed so far, batch after batch. When a stage has ended, the next one takes what is left and
    ends. Counts come from the batches' reports. Each stage has a checkpoint of its own in the shared
    folder, so lost executors cost a batch; a failed stage stops the others and raises.
    """
    spark, out, running = stream.sparkSession, {}, []
    counts, run = Counts(), uuid.uuid4().hex
    spark.streams.addListener(counts)
    try:
        for i, (name, stage) in enumerate(stages):
            path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # the next stage may look before the first commit
            df = counted(stream, stage)
            writer = df.writeStream.queryName(f"{name}-{run}").format("parquet").option("checkpointLocation", state)
            writer = writer.trigger(availableNow=True) if i == 0 else writer.trigger(processingTime="1 second")
            running.append(writer.start(path))
            out[name] = (path, df.schema)
            stream = spark.readStream.schema(df.schema).parquet(path)
        for i, query in enumerate(running):
            if i == 0:
                query.awaitTermination()
            else:
                query.processAllAvailable()
                query.stop()
            counts.await_end(query)
        seen = {name: counts.of(f"{name}-{run}") for name, _ in stages}
    finally:
        for query in running:
            query.stop()
        spark.streams.removeListener(counts)
    return {name: spark.read.schema(schema).parquet(path) for name, (path, schema) in out.items()}, seen


def progress(spark: SparkSession, seen: dict[str, tuple[int, int]]) -> DataFrame:
    """stage, name, done, pending: how many items each stage of a chain has given, and how many of those given to it are held back."""
    rows = [(i, name, given, taken - given) for i, (name, (taken, given)) in enumerate(seen.items())]
    return spark.createDataFrame(rows, "stage int, name string, done long, pending long")
