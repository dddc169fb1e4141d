"""Change capture, event collapse, change logs and sessions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def symbol_diff(old: DataFrame, new: DataFrame, key: str = "name", value: str = "hash") -> DataFrame:
    """(key, change, old, new): added, deleted and modified symbols between two snapshots; a later row of a key wins."""
    a, b = old.select(F.col(key), F.col(value).alias("old")), new.select(F.col(key), F.col(value).alias("new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.withColumn("change", change).where("change IS NOT NULL")


KINDS = ("", "created", "modified", "deleted")


def collapse(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state): each key's events (kind, ts, id) folded to one; created then deleted leaves nothing.

    created+modified is created, modified+deleted is deleted, deleted+created is modified, created+deleted clears, any
    other pair is the later one. Events are dealt in ranges of key and time, so a hot key is several segments; a segment is
    streamed once and becomes a function from the state before it to the state after, and a key's few segments are composed.
    """
    rows = events.select(*keys, "ts", "id", "kind").repartitionByRange(*keys, "ts", "id").sortWithinPartitions(*keys, "ts", "id")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ends", T.MapType(T.StringType(), T.StringType()))])
    n = len(keys)

    def run(batches):
        key, head, ends, steps = None, None, None, {}  # steps: what an event makes of a segment's ends
        for batch in batches:
            cols, out = [c.to_pylist() for c in batch.columns], []
            for row in zip(*cols, strict=True):
                if head is None or row[:n] != key:
                    if head is not None:
                        out.append((*head, list(zip(KINDS, ends, strict=True))))
                    key, head, ends = row[:n], row[: n + 2], KINDS
                step = (ends, row[-1])
                ends = steps[step] if step in steps else steps.setdefault(step, tuple(followed(s, row[-1]) for s in ends))
            yield _segments(out, batch)
            last = batch
        if head is not None:
            yield _segments([(*head, list(zip(KINDS, ends, strict=True)))], last)

    def _segments(out, batch):
        cols = list(zip(*out, strict=True)) if out else [[]] * (n + 3)
        types = [f.type for f in batch.schema][: n + 2] + [pa.map_(pa.string(), pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*batch.schema.names[: n + 2], "ends"])

    parts = rows.mapInArrow(run, schema).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "id", F.map_entries("ends").alias("e")))).alias("x"))
    fold = F.aggregate("x", F.lit(""), lambda s, p: F.element_at(F.map_from_entries(p["e"]), s))
    return parts.select(*keys, fold.alias("state")).where("state <> ''")


def followed(state: str, kind: str) -> str:
    """The state after a change of some kind."""
    if state == "created" and kind in ("deleted", "modified"):
        return "" if kind == "deleted" else "created"
    return "modified" if state == "deleted" and kind == "created" else kind


def changes_since(log: DataFrame, since: str) -> DataFrame:
    """(file, n, symbols) strictly after a time."""
    return log.where(F.col("ts") > F.lit(since).cast("timestamp")).groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))


def sessions(events: DataFrame, user: str, ts: str, gap_hours: float) -> DataFrame:
    """events with `session`, numbered from 1 for each user: a new one starts after a gap of at least so many hours."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w))
    fresh = F.coalesce((gap >= F.lit(int(gap_hours * 3_600_000_000))).cast("int"), F.lit(1))
    return events.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def close_out(log: DataFrame, key: str, order: str = "turn") -> DataFrame:
    """(key, n, roles, last) of a session's records (role, text) when it closes: how many, who took part, and a digest of
    the last one."""
    roles = F.array_join(F.array_sort(F.collect_set("role")), ",")
    return log.groupBy(key).agg(F.count("*").alias("n"), roles.alias("roles"), F.md5(F.max_by("text", order).cast("binary")).alias("last"))


def hotspots(log: DataFrame, half: float = 0.6, least: float = 0.0) -> DataFrame:
    """(file, n, score) of at least `least`: share of the largest count and of the largest number of symbols, weighted half
    and 1 - half."""
    counts = log.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"))
    most = counts.agg(F.max("n").alias("_n"), F.max("symbols").alias("_s"))
    return counts.join(F.broadcast(most), F.lit(True)).select("file", "n", (half * F.col("n") / F.col("_n") + (1 - half) * F.col("symbols") / F.col("_s")).alias("score")).where(F.col("score") >= least)


def totals(log: DataFrame, most: int = 10) -> DataFrame:
    """(section, name, n, added, removed, files, place) of a log (file, session, kind, added, removed): the total, one row a
    kind of change, and the `most` files and sessions with the most changes. Lines that nobody counted are none."""
    sums = [F.count("*").alias("n"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"), F.count_distinct("file").alias("files")]
    columns = ["section", "name", "n", "added", "removed", "files", "place"]
    first = lambda df: df.withColumn("place", F.lit(1))

    def leading(key: str) -> DataFrame:
        best = log.groupBy(F.col(key).alias("name")).agg(*sums).orderBy(F.desc("n"), "name").limit(most)
        return best.withColumn("section", F.lit(key)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "name")))  # of `most` rows

    whole = first(log.agg(*sums).withColumns({"section": F.lit("total"), "name": F.lit(None)}))
    kinds = first(log.groupBy(F.concat(F.lit("kind "), "kind").alias("section")).agg(*sums).withColumn("name", F.lit(None)))
    parts = [whole, kinds, leading("file"), leading("session")]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def pruned(log: DataFrame, now: str, keep: int, days: int) -> DataFrame:
    """The log without rows older than `days`, and of the rest only the newest `keep`."""
    fresh = log.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return fresh.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def freshness(seen: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """(status, n): new, stale, deleted and fresh keys of an index against the present rows."""
    both = seen.select(key, F.col(value).alias("_a")).join(now.select(key, F.col(value).alias("_b")), key, "full_outer")
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "stale").otherwise("fresh")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
