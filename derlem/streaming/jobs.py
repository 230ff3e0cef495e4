"""Structured Streaming forms of the incremental jobs.

Each takes a streaming (or static) DataFrame and returns one; ``run_available`` drains a stream
into a Parquet folder or a function with exactly the checkpoint the caller names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from derlem.operators import citations
from derlem.operators.index import Index
from derlem.session import cut
from derlem.sources.store import Store


def stream_table(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A file stream over Parquet files with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, *, window: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts per key and time window; rows later than ``late`` are dropped by the watermark."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return e.groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def unseen(stream: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key once within the watermark: known ids are skipped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def breaker(events: DataFrame, key: str, order: str, failed: str, *, threshold: int = 3, recovery_s: float = 60.0) -> DataFrame:
    """Transitions of a circuit breaker per key.

    closed opens after ``threshold`` consecutive failures; an attempt ``recovery_s`` after opening
    finds it half open; there a success closes it and a failure opens it again. While it is open,
    attempts are refused and change nothing. ``order`` is a timestamp; within a batch a key's
    events are put in its order.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, streak, opened = state.get if state.exists else ("closed", 0, 0.0)
        rows = pd.concat(list(batches)).sort_values([order, failed], kind="stable")
        out = []
        for t, bad in zip(rows[order], rows[failed]):
            now, before = t.timestamp(), mode
            if mode == "open":
                if now - opened < recovery_s:
                    continue
                mode = before = "half_open"
                out.append((k[0], t, "open", "half_open"))
            if bad:
                streak += 1
                if mode == "half_open" or streak >= threshold:
                    mode, opened = "open", now
            else:
                streak, mode = 0, "closed"
            if mode != before:
                out.append((k[0], t, before, mode))
        state.update((mode, streak, opened))
        yield pd.DataFrame(out, columns=[key, order, "before", "after"])

    kind = events.schema[key].dataType.simpleString()
    slim = events.select(key, F.col(order).cast("timestamp").alias(order), F.col(failed).cast("boolean").alias(failed))
    return slim.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{order}` timestamp, before string, after string", "mode string, streak int, opened double", "append", GroupStateTimeout.NoTimeout)


def rate_limit(events: DataFrame, key: str, order: str, *, most: int, window_s: float, cooldown_s: float = 0.0) -> DataFrame:
    """(key, order, allowed): at most ``most`` calls of a key within ``window_s``; a refusal closes the key for ``cooldown_s``.

    The state is the times of the calls that were let through and the end of the cooldown; times outside the window are dropped.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, closed = (list(state.get[0]), state.get[1]) if state.exists else ([], 0.0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for t in rows[order]:
            now = t.timestamp()
            times = [x for x in times if x > now - window_s]
            ok = now >= closed and len(times) < most
            if ok:
                times.append(now)
            elif now >= closed:
                closed = now + cooldown_s
            out.append((k[0], t, ok))
        state.update((times, closed))
        yield pd.DataFrame(out, columns=[key, order, "allowed"])

    kind = events.schema[key].dataType.simpleString()
    slim = events.select(key, F.col(order).cast("timestamp").alias(order))
    return slim.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{order}` timestamp, allowed boolean", "times array<double>, closed double", "append", GroupStateTimeout.NoTimeout)


def watch(results: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose key was not seen in the run before."""
    return results.join(seen.select(*keys).distinct(), keys, "left_anti")


class Watches:
    """Saved searches under unique names, each with what its last run found."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def names(self) -> dict[str, str]:
        return self.store.read("WATCHES.json") or {}

    def add(self, name: str, query: str) -> None:
        if name in self.names():
            raise ValueError(f"there is a watch named {name}")
        self.store.write("WATCHES.json", self.names() | {name: query})

    def remove(self, name: str) -> bool:
        rest = self.names()
        if rest.pop(name, None) is None:
            return False
        self.store.write("WATCHES.json", rest)
        self.store.delete(f"seen/{name}")
        return True

    def run(self, name: str, search_fn: Callable[[str], DataFrame], keys: list[str]) -> DataFrame:
        """What the search finds now and did not find in its last run; what it finds now takes the place of what was seen."""
        found = cut(search_fn(self.names()[name]).select(*keys).distinct())
        # written beside what was seen before, which the answer still reads
        runs = [int(n[4:]) for n in self.store.names(f"seen/{name}") if n.startswith("run=")]
        n = max(runs, default=0)
        new = cut(watch(found, self.spark.read.parquet(f"{self.store.root}/seen/{name}/run={n}"), keys)) if runs else found
        found.write.mode("overwrite").parquet(f"{self.store.root}/seen/{name}/run={n + 1}")
        for old in runs:
            self.store.delete(f"seen/{name}/run={old}")
        return new


def record_search(spark: SparkSession, folder: str, query: str, mode: str, results: int, ms: float) -> bool:
    """Append a search to the log; a log that cannot be written never fails the search."""
    try:
        row = spark.createDataFrame([(query, mode, results, ms)], "query string, mode string, n_results long, duration_ms double").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(folder)
    except Exception:  # noqa: BLE001  whatever the store raises
        return False
    return True


def keep_index(ix: Index, key: str, text: str) -> Callable[[DataFrame, int], None]:
    """A batch function that adds a batch's documents to an index under its number; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        ix.append(batch, key, text, number=number)

    return write


def keep_edges(folder: str, records: DataFrame, key: str, text: str) -> Callable[[DataFrame, int], None]:
    """A batch function that finds the citations of a batch's texts among ``records`` and keeps them under its number.

    The stream's checkpoint says how far the build has come; a batch that is done again replaces its edges.
    """

    def write(batch: DataFrame, number: int) -> None:
        citations.build_edges(citations.candidates(batch, key, text), records, key).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def keep_latest_rows(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch function for update mode: each batch's rows under its number; ``latest_rows`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def latest_rows(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch that changed it."""
    rows = spark.read.parquet(folder)
    own = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("_r")).select(*keys, "_r.*")


def run_available(df: DataFrame, checkpoint: str, *, to: str | None = None, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process what is there and stop."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (w.foreachBatch(each).start() if each else w.format("parquet").option("path", to).start()).awaitTermination()
