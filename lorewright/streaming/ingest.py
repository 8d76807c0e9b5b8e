"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lorewright.sources.log import LoggedTable


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder; a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def incremental(stream: DataFrame, manifest: str, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives sink each batch's rows whose key the manifest doesn't list, and lists them after it.

    A batch that is replayed after a failure writes its own manifest folder again; its keys are those of the batch, so that
    with a sink that overwrites by key the result is as if it had run once.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{manifest}/batch={number}"
        try:
            listed = spark.read.parquet(manifest).where(F.col("batch") != number)
            new = batch.join(listed.select(key).distinct(), key, "left_anti")
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            new = batch
        new = new.persist()
        sink(new, number)
        new.select(key).distinct().write.mode("overwrite").parquet(own)
        new.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str = "ts", length: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Events and their values per tumbling window and type; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return stream.withWatermark(time, late).groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class SessionProcessor(StatefulProcessor):
    """Sessions of a key in event time, kept as state and given when the watermark has passed their end (S2).

    The state is a sorted list of open sessions (start, last, n), a few for each key, as the watermark closes what lies
    behind it. A key has one timer, at its first session's end; when it fires, all sessions that the watermark has passed go
    out and leave the state, and the timer moves to the next end. So a key is called at most twice in a batch, whatever the
    number of its sessions.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions array<struct<start:bigint,last:bigint,n:bigint>>")

    def _held(self) -> list[tuple[int, int, int]]:
        held = self.open.get()
        return [(x[0], x[1], x[2]) for x in held[0]] if held else []

    def _keep(self, sessions: list[tuple[int, int, int]]) -> None:
        if sessions:
            self.open.update((sessions,))
        else:
            self.open.clear()

    def _end(self, sessions: list[tuple[int, int, int]]) -> int | None:
        """When the first session ends."""
        return sessions[0][1] + self.gap_ms if sessions else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        merged: list[tuple[int, int, int]] = []
        for s in sorted([*held, *((r["ms"], r["ms"], 1) for r in rows)]):
            if merged and s[0] - merged[-1][1] < self.gap_ms:
                merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]), merged[-1][2] + s[2])
            else:
                merged.append(s)
        self._keep(merged)
        before, now = self._end(held), self._end(merged)
        if before != now:
            if before is not None:
                self.handle.deleteTimer(before)
            if now is not None:
                self.handle.registerTimer(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, held = timerValues.getCurrentWatermarkInMs(), self._held()
        over = [s for s in held if s[1] + self.gap_ms <= passed]
        left = held[len(over) :]  # they are sorted, and so are their ends
        if over:
            self._keep(left)
            if left:
                self.handle.registerTimer(self._end(left))
        return iter([Row(user_id=key[0], start_ms=s[0], end_ms=s[1] + self.gap_ms, n=s[2]) for s in over])

    def close(self) -> None:
        pass


def stateful_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end and n of sessions of a stream (user_id, ts) once the watermark has passed their end; later rows are left out, and counted by late_rows()."""
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    rows = stream.withWatermark("ts", late).select("user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp_ltz")).alias("ms"))
    found = rows.groupBy("user_id").transformWithState(SessionProcessor(gap_ms), "user_id bigint, start_ms bigint, end_ms bigint, n bigint", "Append", "EventTime")
    return found.select("user_id", F.timestamp_millis("start_ms").alias("start"), F.timestamp_millis("end_ms").alias("end"), "n")


def late_rows(query: StreamingQuery) -> int:
    """How many rows of a run came behind the watermark, and so take no part; of as many batches as the session keeps progress of."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def run_available(stream: DataFrame, target: LoggedTable, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there, each batch's rows as one commit of the target, and waits for its end.

    The state store is RocksDB's, which keeps a key's state on disk; the checkpoint holds what a restart needs.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        running = stream.writeStream.foreachBatch(lambda batch, number: target.append(batch, number) and None).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        conf.set(name, before)
    return running
