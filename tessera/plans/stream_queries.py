"""Queries of streams and incremental snapshots: the given events and pages replayed, equal to the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera import testgraph as t
from tessera.operators import snapshots
from tessera.plans.registry import query
from tessera.session import shared_folder
from tessera.streaming import bursts

_QUIET_HOURS, _PARTS = 6, 3
_KIND_SQL = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _thirds(events):
    """Events in runs of days: to the 10th, to the 20th, and later."""
    day = F.dayofmonth("ts")
    return [events.where(day <= 10), events.where((day > 10) & (day <= 20)), events.where(day > 20)]


@query(f"""WITH RECURSIVE g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL {_QUIET_HOURS} HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT user_id, burst, {_KIND_SQL} AS kind, ts, row_number() OVER (PARTITION BY user_id, burst ORDER BY ts, event_id) AS i FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)),
f(user_id, burst, i, state) AS (SELECT user_id, burst, i, kind FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.burst, e.i, CASE WHEN f.state = 'created' AND e.kind = 'deleted' THEN '' WHEN f.state = 'created' AND e.kind = 'modified' THEN 'created' WHEN f.state = 'deleted' AND e.kind = 'created' THEN 'modified' ELSE e.kind END FROM f JOIN e ON e.user_id = f.user_id AND e.burst = f.burst AND e.i = f.i + 1),
l AS (SELECT user_id, burst, max_by(state, i) AS state FROM f GROUP BY ALL)
SELECT user_id::VARCHAR AS path, state, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM e JOIN l USING (user_id, burst) GROUP BY user_id, burst, state""")
def c6_bursts_of_a_stream(spark, sf_dir):
    """The events replayed in three batches through state with timers; a last event of a path of its own moves the watermark past all."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    e = t.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), kind.alias("kind"))
    end = e.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).select(F.lit("the end").alias("path"), "ts", F.lit(-1).cast("long").alias("id"), F.lit("created").alias("kind"))
    root = _folder(spark, "bursts")

    def run(stream):
        out = bursts.bursts(stream, _QUIET_HOURS * 3_600_000).writeStream.format("parquet").option("path", f"{root}/out")
        return out.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()

    bursts.replay([*_thirds(e), end], f"{root}/in", run)
    rows = spark.read.schema(bursts.BURST).parquet(f"{root}/out").where("path <> 'the end'")
    return rows.select("path", "state", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


_BATCH_SQL = "CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END"


@query(f"""WITH b AS (SELECT user_id, {_BATCH_SQL} AS part, max_by({{'kind': event_type, 'id': event_id}}, {{'ts': ts, 'id': event_id}}) AS e FROM events GROUP BY ALL),
h AS (SELECT user_id, part, CASE WHEN e.kind <> 'error' THEN e.kind || e.id END AS hash FROM b), x AS (SELECT user_id, part, hash AS new, lag(hash) OVER (PARTITION BY user_id ORDER BY part) AS old FROM h)
SELECT part::BIGINT AS "at", user_id::VARCHAR AS name, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' ELSE 'modified' END AS change, old, new FROM x WHERE old IS DISTINCT FROM new""")
def c1_change_log_of_a_stream(spark, sf_dir):
    """Symbols come in three batches; the second one is replayed into the log afterwards, which stays as it is."""
    e = t.table(spark, sf_dir, "events")
    symbol = F.when(F.col("event_type") != "error", F.concat("event_type", F.col("event_id").cast("string")))
    parts = [p.select(F.col("user_id").cast("string").alias("name"), symbol.alias("hash"), F.col("ts").cast("timestamp").alias("ts")) for p in _thirds(e)]
    root = _folder(spark, "log")
    bursts.log_stream(bursts.replayed(parts, f"{root}/in"), root)
    bursts.log_batch(parts[1], 1, root)
    return bursts.change_log(spark, root)


@query("SELECT url AS path, CASE WHEN page_id % 50 = 3 THEN md5(url) ELSE md5(html) END AS hash FROM pages WHERE page_id % 50 <> 4")
def s11_incremental_snapshot(spark, sf_dir):
    """Pages as files: all are written, then one in fifty is replaced and one in fifty deleted; only their buckets are written anew."""
    p = t.table(spark, sf_dir, "pages")
    rows = p.select("page_id", F.col("url").alias("path"), F.md5(F.col("html").cast("binary")).alias("hash"))
    root = _folder(spark, "files")
    snapshots.replace(rows, rows, root, key="page_id")  # several pages may be of one url
    changed = p.where("page_id % 50 IN (3, 4)").select("page_id")
    new = p.where("page_id % 50 = 3").select("page_id", F.col("url").alias("path"), F.md5(F.col("url").cast("binary")).alias("hash"))
    snapshots.replace(new, changed, root, key="page_id")
    return snapshots.read(spark, root, rows.schema).select("path", "hash")
