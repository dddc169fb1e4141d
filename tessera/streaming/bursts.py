"""Streams with timers and replays: bursts of changes folded until they are quiet, and a change log that a replay leaves as it is.

Bursts are kept by `transformWithState`: a path has a word, a number and two times while its burst lasts. Every event puts
the timer off; when the watermark passes it, the burst comes out and its state goes, so state is bounded by the paths that
are active.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.changes import followed, symbol_diff
from tessera.operators.store import last_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BURST = "path string, state string, n long, first timestamp, last timestamp"


class Bursts(StatefulProcessor):
    """Folds a path's events (us, id, kind) until none has come for `quiet` milliseconds of event time. What comes out is
    plain rows, as most bursts are of an event or two. A burst's timer is known from its last event, so timers aren't listed."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "state string, n long, first long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        burst = before = self.burst.get()
        past, quiet = timerValues.getCurrentWatermarkInMs() * 1000, self.quiet * 1000
        for at, _, kind in sorted((r["us"], r["id"], r["kind"]) for r in rows):
            if at < past:
                continue
            if burst is not None and at - burst[3] >= quiet:  # the timer would have come between them
                yield Row(path=key[0], state=burst[0], n=burst[1], first=burst[2], last=burst[3])
                burst = None
            burst = (kind, 1, at, at) if burst is None else (followed(burst[0], kind), burst[1] + 1, min(burst[2], at), max(burst[3], at))
        if burst is None or burst is before:
            return
        if before is not None:
            self.handle.deleteTimer(before[3] // 1000 + self.quiet)
        self.burst.update(burst)
        self.handle.registerTimer(burst[3] // 1000 + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        burst = self.burst.get()
        if burst is not None:
            self.burst.clear()
            yield Row(path=key[0], state=burst[0], n=burst[1], first=burst[2], last=burst[3])

    def close(self) -> None:
        pass


def bursts(events: DataFrame, quiet_ms: int, late: str = "1 hour") -> DataFrame:
    """(path, state, n, first, last) of a stream of (path, ts, id, kind): each burst of a path's events, once it is over.
    State '' means that nothing came of it. Events older than the watermark are dropped (a policy of ours); others that come
    late join the burst that lasts."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).groupBy("path")
    out = timed.transformWithState(Bursts(quiet_ms), BURST.replace("timestamp", "long"), "Append", "EventTime")
    return out.select("path", "state", "n", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"))


# --- change log

_NAMED = "name string, hash string"


def log_batch(rows: DataFrame, batch: int, root: str) -> None:
    """One micro-batch of symbols (name, hash, ts; a null hash is a deleted one) into a change log and a snapshot below root.

    Both are written for the batch and named by it. What was known before is the newest snapshot of an earlier batch, so a
    batch that is replayed finds the same and writes the same again.
    """
    spark = rows.sparkSession
    new = last_of(rows.where("name IS NOT NULL").select("name", "hash", "ts"), ["name"], F.struct("ts", "hash")).select("name", "hash")
    before = _snapshot(spark, root, batch)
    touched = before.join(new.select("name"), "name", "left_semi")
    changes = symbol_diff(touched, new.where("hash IS NOT NULL"))
    changes.select(F.lit(batch).cast("long").alias("at"), "name", "change", "old", "new").write.mode("overwrite").parquet(f"{root}/log/batch={batch}")
    now = before.join(new.select("name"), "name", "left_anti").unionByName(new.where("hash IS NOT NULL"))
    now.write.mode("overwrite").parquet(f"{root}/symbols/batch={batch}")


def _snapshot(spark, root: str, batch: int) -> DataFrame:
    """Symbols as the newest batch before this one left them."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/symbols")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)] if fs.exists(path) else []
    earlier = [b for b in done if b < batch]
    return spark.read.schema(_NAMED).parquet(f"{root}/symbols/batch={max(earlier)}") if earlier else spark.createDataFrame([], _NAMED)


def change_log(spark, root: str) -> DataFrame:
    """(at, name, change, old, new) of all batches."""
    return spark.read.schema("at long, name string, change string, old string, new string").parquet(f"{root}/log").select("at", "name", "change", "old", "new")


def log_stream(symbols: DataFrame, root: str):
    """Runs a stream of symbols through the change log to its end."""
    write = symbols.writeStream.foreachBatch(lambda rows, batch: log_batch(rows, batch, root))
    write.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def replayed(parts: list[DataFrame], root: str) -> DataFrame:
    """Tables of one schema as a stream that brings one of them a batch: each is written as one file, one after the other."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{root}/part={k}")
    spark = parts[0].sparkSession
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/part=*")


def replay(parts: list[DataFrame], root: str, run) -> None:
    """Tables of one schema as a stream that brings one of them a batch, however many files it has: each is written, then
    `run(stream)` starts the stream, which goes on from its checkpoint to the end of what is there."""
    spark = parts[0].sparkSession
    for k, part in enumerate(parts):
        part.write.parquet(f"{root}/part={k}")
        run(spark.readStream.schema(parts[0].schema).parquet(f"{root}/part=*")).awaitTermination()
