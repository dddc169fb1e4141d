"""Streams with timers, a change log under replay, and snapshots of which only touched buckets are written."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import snapshots, store
from tessera.streaming import bursts, events

EVENT = "path string, ts timestamp, id long, kind string"
T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def run_bursts(spark, folder, parts, quiet=10, late="5 minutes"):
    stream = bursts.replayed([spark.createDataFrame(p, EVENT) for p in parts], f"{folder}/in")
    out = bursts.bursts(stream, quiet * 60_000, late).writeStream.format("parquet").option("path", f"{folder}/out")
    query = out.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(bursts.BURST).parquet(f"{folder}/out").collect()
    return sorted((r.path, r.state, r.n, round((r["first"] - T0).total_seconds() / 60), round((r["last"] - T0).total_seconds() / 60)) for r in rows), query.recentProgress


def test_bursts_end_when_they_are_quiet(spark, tmp_path):
    parts = [
        [("a", at(0), 1, "created"), ("a", at(3), 2, "modified"), ("b", at(1), 3, "created"), ("b", at(2), 4, "deleted"), ("c", at(0), 5, "deleted")],
        [("a", at(9), 6, "deleted"), ("c", at(30), 7, "created"), ("c", at(31), 8, "modified")],  # a goes on, b and c are over
        [("a", at(60), 9, "modified"), ("c", at(2), 10, "created")],  # the last one is too late
        [("end", at(500), 11, "created")],
        [("end", at(501), 12, "created")],
    ]
    got, progress = run_bursts(spark, tmp_path, parts)
    assert [r for r in got if r[0] != "end"] == [("a", "", 3, 0, 9), ("a", "modified", 1, 60, 60), ("b", "", 2, 1, 2), ("c", "created", 2, 30, 31), ("c", "deleted", 1, 0, 0)]
    assert progress[-1].stateOperators[0].numRowsTotal <= 4  # of all paths only the last one's burst and timer are left


def test_parts_of_many_files_are_batches(spark, tmp_path):
    """A part is written and read by many tasks; each is a batch, and a path's bursts within one come out as rows."""
    rows = [[(f"p{i}", at(1000 * k + 20 * j + i % 3), 100 * k + j, "modified") for i in range(40) for j in range(5)] for k in range(2)]
    parts = [spark.createDataFrame(r, EVENT).repartition(6) for r in [*rows, [("end", at(9000), 0, "created")]]]

    def run(stream):
        out = bursts.bursts(stream, 10 * 60_000, "5 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        return out.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()

    bursts.replay(parts, f"{tmp_path}/in", run)
    assert len([n for n in os.listdir(f"{tmp_path}/in/part=0") if n.endswith(".parquet")]) > 1
    got = spark.read.schema(bursts.BURST).parquet(f"{tmp_path}/out").where("path <> 'end'").collect()
    assert sorted((r.path, r["first"], r["last"], r.n) for r in got) == sorted((r[0], r[1], r[1], 1) for part in rows for r in part)


def test_activity_and_sessions_in_windows(spark, tmp_path):
    parts = [[("a", at(0), 1, "x"), ("a", at(30), 2, "x"), ("b", at(70), 3, "y")], [("a", at(900), 4, "x")], [("z", at(9000), 5, "x")]]
    stream = bursts.replayed([spark.createDataFrame(p, EVENT) for p in parts], f"{tmp_path}/in")
    for name, df in (("activity", events.activity(stream)), ("sessions", events.user_sessions(stream))):
        out = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp")
        out.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/activity").select("kind", "n", F.minute("window.start")).collect()
    assert sorted((r.kind, r.n) for r in got) == [("x", 1), ("x", 2), ("y", 1)]
    assert sorted((r.path, r.n) for r in spark.read.parquet(f"{tmp_path}/sessions").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_a_replayed_batch_leaves_the_log_as_it_was(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(list(rows), "name string, hash string, ts timestamp")
    parts = [batch(("f", "1", at(0)), ("g", "1", at(0)), ("f", "2", at(1)), (None, "x", at(0))), batch(("f", "2", at(2)), ("g", None, at(2)), ("h", "1", at(2))), batch(("g", "5", at(3)), ("h", "2", at(3)), ("h", None, at(2)))]
    root = str(tmp_path / "log")
    bursts.log_stream(bursts.replayed(parts, f"{tmp_path}/in"), root)
    want = [(0, "f", "added", None, "2"), (0, "g", "added", None, "1"), (1, "g", "deleted", "1", None), (1, "h", "added", None, "1"), (2, "g", "added", None, "5"), (2, "h", "modified", "1", "2")]
    log = lambda: sorted((tuple(r) for r in bursts.change_log(spark, root).collect()), key=str)
    assert log() == want
    for k in (0, 2, 1):
        bursts.log_batch(parts[k], k, root)
        assert log() == want


def files_below(root):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(root) for n in names if n.endswith(".parquet") and "/lists" not in d}


def test_only_touched_buckets_are_written(spark, tmp_path):
    root, schema = str(tmp_path), "path string, line int"
    df = lambda rows: spark.createDataFrame(rows, schema)
    content = lambda: sorted(tuple(r) for r in snapshots.read(spark, root, schema).collect())
    assert content() == [] and snapshots.version(spark, root) == 0
    first = [(f"f{i}", n) for i in range(200) for n in range(2)]
    assert snapshots.replace(df(first), df(first), root, 16) == 1 and content() == sorted(first)
    before, reader = files_below(root), snapshots.read(spark, root, schema)
    assert snapshots.replace(df([("f7", 9), ("new", 1), ("f9", 5)]), df([("f7", 0), ("new", 0), ("gone", 0)]), root, 16) == 2
    assert content() == sorted([r for r in first if r[0] != "f7"] + [("f7", 9), ("new", 1)])  # f9 wasn't named
    after = files_below(root)
    assert before.items() <= after.items() and len(after) - len(before) <= 3
    assert sorted(tuple(r) for r in reader.collect()) == sorted(first)  # a reader that began before
    snapshots.replace(df([]), df(first + [("new", 1)]), root, 16)
    assert content() == [] and snapshots.version(spark, root) == 3


def test_the_list_of_versions_only_grows(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a", "f")], "id string, filePath string"), spark.createDataFrame([], "sourceId string, targetId string, type string")
    for v in ("v2", "v10", "v1"):
        store.publish(spark, {"nodes": nodes.withColumn("id", F.lit(v)), "edges": edges}, str(tmp_path), v)
        assert store.current(spark, str(tmp_path))["nodes"].first().id == v
