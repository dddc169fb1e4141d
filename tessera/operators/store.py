"""Snapshots of the graph and its changes: replace, delete and clean up; change records, deltas and diffs.

A snapshot is a pair of tables. Every operation gives the next snapshot as a plan (anti-joins and unions); `publish` writes
one beside the last and then adds its name to a list, so readers see whole snapshots only. Tables of which few files change
are kept in buckets (snapshots.py).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE_KEY = ["sourceId", "targetId", "type"]


# --- upserts and deletes


def last_of(rows: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """One row for each key: the last by order. Without an order equal keys keep any one, as sets do."""
    if order is None:
        return rows.dropDuplicates(key)
    newest = Window.partitionBy(*key).orderBy(order.desc())
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """New rows replace old ones of their key."""
    new = last_of(new, key, order)
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without some ids (id) and all edges at them."""
    kept = edges
    for end in ("sourceId", "targetId"):
        kept = kept.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(ids.select("id"), "id", "left_anti"), kept.select(*edges.columns)


def without_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of some files (filePath)."""
    gone = nodes.join(files.select("filePath").distinct(), "filePath", "left_semi").select("id")
    return without_nodes(nodes, edges, gone)


def without_project(nodes: DataFrame, edges: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of files below a folder, whichever way its path is written."""
    root = root.replace("\\", "/").rstrip("/") + "/"
    gone = nodes.where(F.startswith(F.translate("filePath", "\\", "/"), F.lit(root))).select("id")
    return without_nodes(nodes, edges, gone)


def replace_files(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with some files' data (filePath) replaced: what was of them goes, with all edges at it, what is new comes."""
    left_nodes, left_edges = without_files(nodes, edges, files)
    return upsert(left_nodes, new_nodes, ["id"]), upsert(left_edges, new_edges, EDGE_KEY)


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return reduce(lambda e, end: e.join(ids.withColumnRenamed("id", end), end, "left_semi"), ("sourceId", "targetId"), edges).select(*edges.columns)


def by_ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Nodes of a list of ids, in its order, with their place; ids without a node leave a gap."""
    places = nodes.sparkSession.createDataFrame([(i, at) for at, i in enumerate(dict.fromkeys(ids))], "id string, place int")
    return nodes.join(F.broadcast(places), "id").orderBy("place")  # as long as the caller's list


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes a snapshot's tables below root/version, then appends its name to root/versions: rows there are only added, so
    a reader always finds one, and one that is whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/versions")


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables nodes and edges of the snapshot that was published last."""
    version = spark.read.schema("version string, at timestamp").parquet(f"{root}/versions").agg(F.max_by("version", "at")).first()[0]
    return {name: spark.read.parquet(f"{root}/{version}/{name}") for name in ("nodes", "edges")}


# --- change records


def change_records(events: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """A record for each event (path, kind, ts): symbols affected are those that the file had or has (path, name), lines
    are the change of their number, and the summary says what happened to which file."""
    before = old.groupBy("path").agg(F.collect_set("name").alias("_old"), F.count("*").alias("_n"))
    after = new.groupBy("path").agg(F.collect_set("name").alias("_new"), F.count("*").alias("_m"))
    none, gone = F.array().cast("array<string>"), F.col("kind") == "deleted"
    rows = events.join(before, "path", "left").join(after, "path", "left")
    names = F.when(gone, none).otherwise(F.array_union(F.coalesce("_old", none), F.coalesce("_new", none)))
    n, m = (F.when(gone, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long") for c in ("_n", "_m"))
    return rows.select(
        "path", F.col("kind").alias("changeType"), F.concat(F.lit("File "), "kind", F.lit(": "), F.element_at(F.split("path", "/"), -1)).alias("summary"),
        F.array_join(F.array_sort(names), ",").alias("symbols"), F.greatest(F.lit(0), m - n).alias("linesAdded"), F.greatest(F.lit(0), n - m).alias("linesRemoved"), "ts",
    )


def find_changes(log: DataFrame, session: str | None = None, path: str | None = None, kinds: list[str] | None = None, since=None, until=None, symbol: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Records (id, session, path, changeType, ts, symbols array) that meet all conditions given, the newest first."""
    conditions = [
        (session, lambda: F.col("session") == session), (path, lambda: F.col("path") == path), (kinds, lambda: F.col("changeType").isin(kinds)),
        (since, lambda: F.col("ts") >= F.lit(since).cast("timestamp")), (until, lambda: F.col("ts") <= F.lit(until).cast("timestamp")), (symbol, lambda: F.array_contains("symbols", symbol)),
    ]
    out = reduce(lambda d, c: d.where(c[1]()) if c[0] is not None else d, conditions, log).orderBy(F.desc("ts"), F.desc("id"))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def any_match(rows: DataFrame, tags: list[str] = (), files: list[str] = (), categories: list[str] = (), importance: float | None = None) -> DataFrame:
    """Rows (tags, files, category, importance) with any of the tags (case ignored), any of the files (slashes and case
    alike), one of the categories and at least so much importance."""
    path = lambda x: F.lower(F.translate(x, "\\", "/"))
    if tags:
        rows = rows.where(F.arrays_overlap(F.transform("tags", F.lower), F.array(*(F.lit(t.lower()) for t in tags))))
    if files:
        rows = rows.where(F.arrays_overlap(F.transform("files", path), F.array(*(F.lit(f.replace("\\", "/").lower()) for f in files))))
    if categories:
        rows = rows.where(F.col("category").isin(list(categories)))
    return rows if importance is None else rows.where(F.col("importance") >= importance)


# --- sessions of changes


def session_counts(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """sessions (session, ..) with the number of their records, none for some."""
    n = log.groupBy("session").agg(F.count("*").alias("records"))
    return sessions.join(n, "session", "left").na.fill(0, ["records"])


def file_hotspots(log: DataFrame) -> DataFrame:
    """(path, n, symbols): changes of each file and how often each symbol was among them, as 'name:n,..', the most first."""
    by_symbol = log.select("path", F.explode("symbols").alias("symbol")).groupBy("path", "symbol").agg(F.count("*").alias("n"))
    counters = by_symbol.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "symbol"))).alias("x"))
    text = F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["symbol"], (-s["n"]).cast("string"))), ",")
    return log.groupBy("path").agg(F.count("*").alias("n")).join(counters.select("path", text.alias("symbols")), "path", "left")


# --- times


def age_label(past: Column, now: Column) -> Column:
    """How long ago: 59s, 59m, 23h, 7d."""
    s = F.floor((F.unix_micros(now) - F.unix_micros(past)) / 1_000_000).cast("long")
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, part(1, "s")).when(s < 3600, part(60, "m")).when(s < 86_400, part(3600, "h")).otherwise(part(86_400, "d"))


_UNITS = {"m": "minutes", "h": "hours", "d": "days"}


def resolve_time(said: str, now: Column, last_session: Column | None = None) -> Column:
    """The time that words mean: last_session (its end, or four hours ago), today, this_week (from Monday), a number of
    minutes, hours or days ago, or a time itself."""
    if said == "last_session":
        ago = now - F.expr("INTERVAL 4 HOURS")
        return ago if last_session is None else F.coalesce(last_session, ago)
    if said in ("today", "this_week"):
        return F.date_trunc("day" if said == "today" else "week", now)
    ago = re.fullmatch(r"(\d+)([mhd])", said)
    return now - F.expr(f"INTERVAL {ago[1]} {_UNITS[ago[2]]}") if ago else F.lit(said).cast("timestamp")


def cached_digest(cache: DataFrame, key: str, now: Column, minutes: int = 5) -> DataFrame:
    """The digest (key, made, text) if it is younger than so many minutes."""
    return cache.where((F.col("key") == key) & (F.unix_micros(now) - F.unix_micros("made") < minutes * 60_000_000))


def undrained(events: DataFrame, most: int = 10_000, keep: int = 5_000) -> DataFrame:
    """A buffer of events (ts, id) as it is, or its newest `keep` if there are more than `most` (a feature of the buffer)."""
    n = events.limit(most + 1).count()
    return events if n <= most else events.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


# --- diffs


def numstat(lines: DataFrame) -> DataFrame:
    """(file, insertions, deletions) of `git diff --numstat` lines; binary files count no lines."""
    part = F.split("line", "\t")
    number = lambda i: F.coalesce(F.try_to_number(F.get(part, F.lit(i)), F.lit("9999999999")), F.lit(0)).cast("long")
    return lines.where(F.size(part) >= 3).select(F.array_join(F.slice(part, 3, 1_000), "\t").alias("file"), number(0).alias("insertions"), number(1).alias("deletions"))


def log_entries(lines: DataFrame) -> DataFrame:
    """(hash, author, date, subject) of `git log --format=%H%x09%an%x09%aI%x09%s` lines."""
    part = F.split("line", "\t", 4)
    return lines.where(F.size(part) == 4).select(*(F.get(part, F.lit(i)).alias(n) for i, n in enumerate(("hash", "author", "date", "subject"))))


def merged_diffs(*parts: DataFrame) -> DataFrame:
    """Diffs (file, insertions, deletions), such as staged and unstaged ones, by file with their lines added up."""
    return reduce(DataFrame.unionByName, parts).groupBy("file").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


def file_changes(diffs: DataFrame) -> DataFrame:
    """(path, oldPath, changeType, summary, linesAdded, linesRemoved) of diffs. A name with ' => ' is a rename, in braces of
    a part of the path only; lines that only come are a new file."""
    f = F.col("file")
    braces, plain = r"^(.*)\{(.+?) => (.+?)\}(.*)$", r"^(.+?) => (.+?)$"
    side = lambda g: F.regexp_replace(F.concat(F.regexp_extract(f, braces, 1), F.regexp_extract(f, braces, g), F.regexp_extract(f, braces, 4)), "//", "/")
    old = F.when(f.rlike(braces), side(2)).when(f.rlike(plain), F.regexp_extract(f, plain, 1))
    new = F.when(f.rlike(braces), side(3)).when(f.rlike(plain), F.regexp_extract(f, plain, 2)).otherwise(f)
    kind = F.when(old.isNotNull(), "renamed").when((F.col("insertions") > 0) & (F.col("deletions") == 0), "created").otherwise("modified")
    rows = diffs.select(new.alias("path"), old.alias("oldPath"), kind.alias("changeType"), F.col("insertions").alias("linesAdded"), F.col("deletions").alias("linesRemoved"))
    says = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    plus, minus = F.col("linesAdded").cast("string"), F.col("linesRemoved").cast("string")
    summary = F.when(F.col("changeType") == "created", says("Created (+", plus, " lines)")).when(F.col("changeType") == "renamed", says("Renamed from ", F.col("oldPath"), " (+", plus, ", -", minus, " lines)"))
    return rows.withColumn("summary", summary.otherwise(says("Modified (+", plus, ", -", minus, " lines)")))


def symbol_marks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, symbols): names (path, name) that came as +name and that went as -name, in order."""
    gone = old.distinct().join(new, ["path", "name"], "left_anti").select("path", F.concat(F.lit("-"), "name").alias("mark"))
    come = new.distinct().join(old, ["path", "name"], "left_anti").select("path", F.concat(F.lit("+"), "name").alias("mark"))
    return come.unionAll(gone).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("mark")), ",").alias("symbols"))


def delta_summary(changes: DataFrame, hot: int = 20, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """One row (summary) over changes (path, changeType, linesAdded, linesRemoved), and the hot files: the `most` with the
    most lines of those with more than `hot`."""
    n = lambda kind: F.count_if(F.col("changeType") == kind)
    one = changes.agg(F.count("*").alias("n"), n("created").alias("new"), n("modified").alias("modified"), n("deleted").alias("deleted"), F.coalesce(F.sum("linesAdded"), F.lit(0)).alias("plus"), F.coalesce(F.sum("linesRemoved"), F.lit(0)).alias("minus"))
    words = F.concat_ws(", ", *(F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c).cast("string"), F.lit(c))) for c in ("new", "modified", "deleted")), F.concat(F.lit("+"), F.col("plus").cast("string"), F.lit("/-"), F.col("minus").cast("string")))
    lines = F.col("linesAdded") + F.col("linesRemoved")
    top = changes.where(lines > hot).orderBy(lines.desc(), "path").limit(most)
    return one.select(F.when(F.col("n") == 0, "No changes.").otherwise(words).alias("summary")), top.select("path", F.concat(F.lit("+"), F.col("linesAdded").cast("string"), F.lit("/-"), F.col("linesRemoved").cast("string")).alias("lines"))


def signature_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, name, change) of callables (path, name, signature) that came, went or changed their signature."""
    a, b = old.select("path", "name", F.col("signature").alias("_a")), new.select("path", "name", F.col("signature").alias("_b"))
    both = a.join(b, ["path", "name"], "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "signature_changed")
    return both.select("path", "name", change.alias("change")).where("change IS NOT NULL")
