"""Queries of snapshots, change records, notes and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as t
from tessera.operators import memory, store
from tessera.plans.registry import query

WITH = f"WITH {t.CTES}"


def _graph(spark, sf_dir):
    return t.nodes(spark, sf_dir), t.edges(spark, sf_dir)


def _counts(nodes, edges):
    n = nodes.groupBy(F.lit("node").alias("what"), "type").agg(F.count("*").alias("n"))
    return n.unionAll(edges.groupBy(F.lit("edge").alias("what"), "type").agg(F.count("*").alias("n")))


_LEFT = "SELECT 'node' AS what, type, count(*) AS n FROM n2 GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e2 GROUP BY type"


@query(f"{WITH}, gone AS (SELECT id FROM nodes WHERE filePath LIKE '/src/nation1%'), n2 AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone)), e2 AS (SELECT * FROM edges WHERE sourceId NOT IN (SELECT id FROM gone) AND targetId NOT IN (SELECT id FROM gone)) {_LEFT}")
def s12_delete_files(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return _counts(*store.without_files(nodes, edges, nodes.where("filePath LIKE '/src/nation1%'").select("filePath")))


@query(f"{WITH}, gone AS (SELECT id FROM nodes WHERE filePath LIKE '/test/%'), n2 AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone)), e2 AS (SELECT * FROM edges WHERE sourceId NOT IN (SELECT id FROM gone) AND targetId NOT IN (SELECT id FROM gone)) {_LEFT}")
def s12_clear_project(spark, sf_dir):
    return _counts(*store.without_project(*_graph(spark, sf_dir), "\\test\\"))


@query(f"{WITH}, old_ones AS (SELECT * FROM nodes WHERE filePath = '/lib/Brand#11.go'), n2 AS (SELECT id, CASE WHEN filePath = '/lib/Brand#11.go' THEN 'hook' ELSE type END AS type FROM nodes), e2 AS (SELECT * FROM edges WHERE sourceId NOT IN (SELECT id FROM old_ones) AND targetId NOT IN (SELECT id FROM old_ones) UNION ALL SELECT id, 'r:1', 'exports' FROM old_ones) {_LEFT}")
def s11_replace_files(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    new = nodes.where("filePath = '/lib/Brand#11.go'").withColumn("type", F.lit("hook"))
    new_edges = new.select(F.col("id").alias("sourceId"), F.lit("r:1").alias("targetId"), F.lit("exports").alias("type"))
    return _counts(*store.replace_files(nodes, edges, new, new_edges, new.select("filePath")))


@query(f"{WITH}, n2 AS (SELECT * FROM nodes WHERE type <> 'namespace'), e2 AS (SELECT * FROM edges WHERE sourceId IN (SELECT id FROM n2) AND targetId IN (SELECT id FROM n2)) {_LEFT}")
def s12_clean_orphans(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    nodes = nodes.where("type <> 'namespace'")
    return _counts(nodes, store.without_orphans(nodes, edges))


@query(f"{WITH} SELECT id, name, CASE id WHEN 'p:7' THEN 0 WHEN 'r:1' THEN 1 WHEN 'o:5' THEN 3 END AS place FROM nodes WHERE id IN ('p:7', 'r:1', 'o:5')")
def s9_nodes_by_ids(spark, sf_dir):
    return store.by_ids(t.nodes(spark, sf_dir), ["p:7", "r:1", "none", "o:5", "p:7"]).select("id", "name", "place")


_KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END"
_REC = f"e AS (SELECT user_id::VARCHAR AS path, {_KIND} AS kind, event_id FROM events), o AS (SELECT user_id::VARCHAR AS path, list_sort(list_distinct(list(event_type))) AS s, count(*) AS n FROM events WHERE day(ts) <= 10 GROUP BY 1), w AS (SELECT user_id::VARCHAR AS path, list_sort(list_distinct(list(event_type))) AS s, count(*) AS n FROM events WHERE day(ts) > 10 GROUP BY 1)"


@query(f"WITH {_REC} SELECT e.path, kind AS changeType, 'File ' || kind || ': ' || e.path AS summary, CASE WHEN kind = 'deleted' THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(coalesce(o.s, []), coalesce(w.s, [])))), ',') END AS symbols, CASE WHEN kind = 'deleted' THEN 0 ELSE greatest(0, coalesce(w.n, 0) - coalesce(o.n, 0)) END::BIGINT AS linesAdded, CASE WHEN kind = 'deleted' THEN 0 ELSE greatest(0, coalesce(o.n, 0) - coalesce(w.n, 0)) END::BIGINT AS linesRemoved FROM e LEFT JOIN o USING (path) LEFT JOIN w USING (path)")
def c8_change_records(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    names = e.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("name"), "ts")
    events = e.select(F.col("user_id").cast("string").alias("path"), kind.alias("kind"), "ts")
    return store.change_records(events, names.where("day(ts) <= 10"), names.where("day(ts) > 10")).drop("ts")


def _log(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return t.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("session"), F.col("user_id").cast("string").alias("path"), kind.alias("changeType"), "ts", F.array("event_type").alias("symbols"))


@query(f"SELECT event_id AS id, user_id::VARCHAR AS path FROM events WHERE {_KIND} IN ('created', 'modified') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND event_type = 'click' AND user_id % 10 = 3 ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10")
def p11_find_changes(spark, sf_dir):
    return store.find_changes(_log(spark, sf_dir), session=3, kinds=["created", "modified"], since="2024-01-05", until="2024-01-25", symbol="click", limit=50, offset=10).select("id", "path")


@query("SELECT user_id::VARCHAR AS path, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def p9_array_membership(spark, sf_dir):
    return store.find_changes(_log(spark, sf_dir), symbol="click").groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE lang IN ('de', 'fr') AND lower(source) IN ('src1', 'src2') AND quality = 1")
def p10_any_match(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select(F.col("doc_id").alias("id"), F.array("lang").alias("tags"), F.array(F.upper("source")).alias("files"), F.lit("x").alias("category"), F.col("quality").cast("double").alias("importance"))
    return store.any_match(rows, ["DE", "Fr"], ["SRC1", "src2"], ["x"], 0.5).select("id")


@query("SELECT s.session, coalesce(count(e.event_id), 0)::BIGINT AS records FROM (SELECT unnest(range(0, 12)) AS session) s LEFT JOIN events e ON e.user_id % 10 = s.session GROUP BY s.session")
def j7_sessions_with_records(spark, sf_dir):
    return store.session_counts(spark.range(12).select(F.col("id").alias("session")), _log(spark, sf_dir)).select("session", "records")


@query("SELECT c.conv_id AS session, c.text AS last, (SELECT count(*) FROM conversations f WHERE f.conv_id = c.conv_id) AS facts FROM conversations c WHERE c.turn = (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id)")
def j8_session_facts(spark, sf_dir):
    t.table(spark, sf_dir, "conversations").createOrReplaceTempView("_conversations")
    return spark.sql("SELECT c.conv_id AS session, c.text AS last, (SELECT count(*) FROM _conversations f WHERE f.conv_id = c.conv_id) AS facts FROM _conversations c WHERE c.turn = (SELECT max(turn) FROM _conversations m WHERE m.conv_id = c.conv_id)")


@query("WITH s AS (SELECT user_id::VARCHAR AS path, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT path, sum(n)::BIGINT AS n, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS symbols FROM s GROUP BY path")
def a11_file_hotspots(spark, sf_dir):
    return store.file_hotspots(_log(spark, sf_dir))


@query("SELECT event_id AS id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age FROM (SELECT event_id, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1000000)::BIGINT AS s FROM events)")
def c11_age_labels(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), store.age_label(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("age"))


@query("SELECT said, count(*) AS n FROM (SELECT unnest(['last_session', 'today', 'this_week', '90m', '36h', '7d', '2024-01-20 12:00:00']) AS said, unnest([TIMESTAMP '2024-01-30 11:00:00', TIMESTAMP '2024-01-30', TIMESTAMP '2024-01-29', TIMESTAMP '2024-01-30 13:30:00', TIMESTAMP '2024-01-29 03:00:00', TIMESTAMP '2024-01-23 15:00:00', TIMESTAMP '2024-01-20 12:00:00']) AS since) w JOIN events e ON e.ts >= w.since GROUP BY said")
def c11_relative_times(spark, sf_dir):
    now, out = F.lit("2024-01-30 15:00:00").cast("timestamp"), None
    for said in ("last_session", "today", "this_week", "90m", "36h", "7d", "2024-01-20 12:00:00"):
        one = t.table(spark, sf_dir, "events").where(F.col("ts") >= store.resolve_time(said, now)).agg(F.lit(said).alias("said"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out.where("n > 0")


_STAT = [("3\t1\tsrc/a.py", "staged"), ("2\t0\tsrc/a.py", "not staged"), ("10\t0\tsrc/new.py", "staged"), ("1\t1\tsrc/{old => new}/b.py", "staged"), ("0\t0\tx.py => y.py", "staged"), ("-\t-\timg/{ => sub}/p.png", "staged"), ("0\t7\tsrc/c.py", "not staged"), ("no stat", "staged")]


@query("SELECT * FROM (VALUES ('src/a.py', NULL, 'modified', 'Modified (+5, -1 lines)', 5::BIGINT, 1::BIGINT), ('src/new.py', NULL, 'created', 'Created (+10 lines)', 10, 0), ('src/new/b.py', 'src/old/b.py', 'renamed', 'Renamed from src/old/b.py (+1, -1 lines)', 1, 1), ('y.py', 'x.py', 'renamed', 'Renamed from x.py (+0, -0 lines)', 0, 0), ('sub}/p.png', 'img/{', 'renamed', 'Renamed from img/{ (+0, -0 lines)', 0, 0), ('src/c.py', NULL, 'modified', 'Modified (+0, -7 lines)', 0, 7)) AS v(path, oldPath, changeType, summary, linesAdded, linesRemoved)"
       + " UNION ALL SELECT 'lib/p' || p_partkey || '.py', NULL, 'modified', 'Modified (+' || (a + b) || ', -' || (d + b) || ' lines)', a + b, d + b FROM (SELECT p_partkey, 1 + p_partkey % 9 AS a, 1 + p_partkey % 4 AS d, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS b FROM part)")
def c10_merged_diffs(spark, sf_dir):
    lines, key = spark.createDataFrame(_STAT, "line string, part string"), F.col("p_partkey")
    stat = lambda a, d: F.concat_ws("\t", a.cast("string"), d.cast("string"), F.concat(F.lit("lib/p"), key.cast("string"), F.lit(".py")))
    part = t.table(spark, sf_dir, "part")
    lines = lines.unionAll(part.select(stat(1 + key % 9, 1 + key % 4), F.lit("staged"))).unionAll(part.where(key % 2 == 0).select(stat(F.lit(1), F.lit(1)), F.lit("not staged")))
    return store.file_changes(store.merged_diffs(store.numstat(lines.where("part = 'staged'")), store.numstat(lines.where("part <> 'staged'"))))


@query("SELECT * FROM (VALUES ('a1', 'Ann', '2024-01-02T03:04:05+00:00', 'Fix tabs\tand more'), ('b2', 'Bo', '2024-01-03T00:00:00+00:00', 'Add')) AS v(hash, author, date, subject)"
       + " UNION ALL SELECT 'h' || event_id, 'user ' || user_id, '2024-01-01T00:00:00+00:00', event_type || chr(9) || event_id FROM events")
def s19_git_log(spark, sf_dir):
    lines = [("a1\tAnn\t2024-01-02T03:04:05+00:00\tFix tabs\tand more",), ("b2\tBo\t2024-01-03T00:00:00+00:00\tAdd",), ("broken",)]
    as_text = lambda c: F.col(c).cast("string")
    own = t.table(spark, sf_dir, "events").select(F.concat_ws("\t", F.concat(F.lit("h"), as_text("event_id")), F.concat(F.lit("user "), as_text("user_id")), F.lit("2024-01-01T00:00:00+00:00"), "event_type", as_text("event_id")))
    return store.log_entries(spark.createDataFrame(lines, "line string").unionAll(own))


_MARKS = "o AS (SELECT DISTINCT user_id::VARCHAR AS path, event_type AS name FROM events WHERE day(ts) <= 4), w AS (SELECT DISTINCT user_id::VARCHAR AS path, event_type AS name FROM events WHERE day(ts) >= 27)"


@query(f"WITH {_MARKS} SELECT path, string_agg(mark, ',' ORDER BY mark) AS symbols FROM (SELECT path, '+' || name AS mark FROM (SELECT * FROM w EXCEPT SELECT * FROM o) UNION ALL SELECT path, '-' || name FROM (SELECT * FROM o EXCEPT SELECT * FROM w)) GROUP BY path")
def u5_symbol_marks(spark, sf_dir):
    names = t.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("name"), "ts")
    return store.symbol_marks(*(names.where(c).select("path", "name") for c in ("day(ts) <= 4", "day(ts) >= 27")))


_DELTA = "d AS (SELECT o_orderpriority AS path, CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'F' THEN 'modified' ELSE 'deleted' END AS kind, count(*) AS plus, (sum(o_orderkey) % 100)::BIGINT AS minus FROM orders GROUP BY ALL)"


@query(f"WITH {_DELTA} SELECT 'summary' AS part, concat_ws(', ', count(*) FILTER (kind = 'created') || ' new', count(*) FILTER (kind = 'modified') || ' modified', count(*) FILTER (kind = 'deleted') || ' deleted', '+' || sum(plus) || '/-' || sum(minus)) AS text FROM d UNION ALL (SELECT 'hot', path || ' +' || plus || '/-' || minus FROM d WHERE plus + minus > 20 ORDER BY plus + minus DESC, path, kind LIMIT 5)")
def c9_delta(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "O", "created").when(F.col("o_orderstatus") == "F", "modified").otherwise("deleted")
    d = t.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("path"), kind.alias("changeType")).agg(F.count("*").alias("linesAdded"), (F.sum("o_orderkey") % 100).alias("linesRemoved"))
    one, hot = store.delta_summary(d)
    return one.select(F.lit("summary").alias("part"), F.col("summary").alias("text")).unionAll(hot.select(F.lit("hot"), F.concat_ws(" ", "path", "lines")))


@query("WITH o AS (SELECT p_brand AS path, p_partkey AS name, p_type AS signature FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_brand AS path, p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_type END AS signature FROM part WHERE p_partkey % 4 <> 0) SELECT * FROM (SELECT coalesce(o.path, n.path) AS path, coalesce(o.name, n.name) AS name, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.signature <> n.signature THEN 'signature_changed' END AS change FROM o FULL JOIN n ON o.path = n.path AND o.name = n.name) WHERE change IS NOT NULL")
def j14_signature_diff(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("name"), F.col("p_type").alias("signature"), "p_name")
    new = p.where("name % 4 <> 0").withColumn("signature", F.when(F.col("name") % 5 == 0, F.col("p_name")).otherwise(F.col("signature")))
    return store.signature_diff(p.where("name % 3 <> 0"), new)


@query("SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def c7_undrained_buffer(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id"))
    return store.undrained(e, 9_000, 5_000).select("id")


@query("WITH e AS (SELECT event_id, event_type, ts FROM events WHERE user_id = 7) SELECT '7' AS key, event_type || event_id AS text FROM e WHERE epoch_us((SELECT max(ts) FROM e)) + 120000000 - epoch_us(ts) < 300000000")
def c5_digest_cache(spark, sf_dir):
    """A user's events as digests, two minutes after the last one."""
    e = t.table(spark, sf_dir, "events")
    last = e.where("user_id = 7").agg(F.max("ts")).first()[0]
    rows = e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("made"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return store.cached_digest(rows, "7", F.lit(last).cast("timestamp") + F.expr("INTERVAL 2 MINUTES")).select("key", "text")


_W = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')))"
_NOTES = "n AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'gotcha' WHEN 1 THEN 'todo' ELSE 'context' END AS category, p_name || ' ' || p_type AS content, p_brand AS tag FROM part)"


def _notes(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "gotcha").when(F.col("p_partkey") % 3 == 1, "todo").otherwise("context")
    return p.select(F.col("p_partkey").alias("id"), kind.alias("category"), F.concat_ws(" ", "p_name", "p_type").alias("content"), F.lit(None).cast("double").alias("importance"), F.array("p_brand").alias("tags"), F.array().cast("array<string>").alias("files"))


@query(f"""WITH RECURSIVE {_NOTES}, w AS (SELECT *, {_W.format('content')} AS w FROM n), p AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.category = b.category AND a.id <> b.id AND len(list_intersect(a.w, b.w)) >= 0.8 * len(list_distinct(list_concat(a.w, b.w)))),
r(id, root) AS (SELECT id, id FROM n UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id), l AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT root AS id, min(n.category) AS category, count(*) - 1 AS merges, round(least(1, max(CASE n.category WHEN 'gotcha' THEN 0.85 WHEN 'todo' THEN 0.5 ELSE 0.6 END) + (count(*) - 1) * 0.15)::DOUBLE, 6) AS importance, max_by(content, (length(content), -n.id)) AS content, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM l JOIN n USING (id) GROUP BY root""")
def m1_create_with_merge(spark, sf_dir):
    return memory.created(_notes(spark, sf_dir)).select("id", "category", "merges", F.round("importance", 6).alias("importance"), "content", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("SELECT category, count(*) AS n, round(avg(importance), 6) AS importance, min(created)::VARCHAR AS first, max(created)::VARCHAR AS last, sum(hits)::BIGINT AS accesses FROM (SELECT event_type AS category, user_id / 1000 AS importance, CAST(ts AS DATE) AS created, user_id AS hits FROM events) GROUP BY GROUPING SETS ((category), ())")
def a12_memory_stats(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("user_id") / 1000).alias("importance"), F.date_format("ts", "yyyy-MM-dd").alias("created_at"), F.col("user_id").alias("access_count"))
    return memory.memory_stats(e).withColumn("importance", F.round("importance", 6))


def _decisions(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "superseded").otherwise("reversed")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit(None).cast("long").alias("superseded_by"), F.col("o_totalprice").cast("double").alias("decided_at"), F.col("o_orderpriority").alias("title"), F.concat_ws(" ", F.col("o_orderpriority"), F.repeat(F.lit("why "), 20)).alias("rationale"), F.array("o_orderpriority").alias("tags"))


_DEC = "d AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded' ELSE 'reversed' END AS status, o_totalprice::DOUBLE AS decided, o_orderpriority AS title, o_orderpriority || ' ' || repeat('why ', 20) AS rationale FROM orders)"


@query(f"WITH {_DEC}, a AS (SELECT min(id) FILTER (status = 'active') AS x, max(id) FILTER (status = 'active') AS y, min(id) FILTER (status = 'reversed') AS z FROM d) SELECT id, CASE WHEN id = x THEN 'superseded' WHEN id = y THEN 'reversed' WHEN id = z THEN 'active' ELSE status END AS status, CASE WHEN id = x THEN y END AS superseded_by FROM d, a")
def d1_decision_states(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    x, y, z = d.agg(F.min(F.when(F.col("status") == "active", F.col("id"))), F.max(F.when(F.col("status") == "active", F.col("id"))), F.min(F.when(F.col("status") == "reversed", F.col("id")))).first()
    d = memory.decided(memory.decided(memory.decided(d, "supersede", x, y), "reverse", y), "reactivate", z)
    return memory.decided(d, "reverse", x).select("id", "status", "superseded_by")  # x isn't active any more


@query(f"WITH {_DEC}, c AS (SELECT count(*) AS n FROM d) SELECT id, status FROM d WHERE id NOT IN (SELECT id FROM d WHERE status <> 'active' ORDER BY decided, id LIMIT (SELECT n - 9000 FROM c))")
def d1_capacity(spark, sf_dir):
    return memory.trimmed(_decisions(spark, sf_dir), 9_000).select("id", "status")


@query(f"WITH {_DEC} SELECT row_number() OVER (ORDER BY decided DESC, id)::INTEGER AS place, row_number() OVER (ORDER BY decided DESC, id) || '. [' || title || '] ' || title || ' — ' || CASE WHEN length(rationale) > 60 THEN left(rationale, 57) || '...' ELSE rationale END AS line FROM d WHERE status = 'active'")
def d2_context_lines(spark, sf_dir):
    return memory.context_lines(_decisions(spark, sf_dir))


@query("""WITH h AS (SELECT lower(trim(p_name)) AS k, CASE p_partkey % 2 WHEN 0 THEN 'active' ELSE 'reversed' END AS status, p_partkey AS id FROM part WHERE p_partkey % 3 <> 0), t AS (SELECT k, arg_min(status, id) AS status FROM (SELECT lower(trim(p_name)) AS k, 'active' AS status, p_partkey AS id FROM part WHERE p_partkey % 4 <> 0) GROUP BY k),
x AS (SELECT h.k, coalesce(t.status, h.status) AS status, t.k IS NOT NULL AND t.status <> h.status AS changed FROM h LEFT JOIN t USING (k)), new AS (SELECT * FROM t WHERE k NOT IN (SELECT k FROM h))
SELECT 'decision' AS kind, (SELECT count(*) FROM new) + (SELECT count(*) FROM x WHERE changed) AS imported, (SELECT count(*) FROM x WHERE (k, status) NOT IN (SELECT (k, status) FROM t)) AS exported""")
def b1_sync_decisions(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"))
    here = p.where("id % 3 <> 0").withColumn("status", F.when(F.col("id") % 2 == 0, "active").otherwise("reversed"))
    there = p.where("id % 4 <> 0").withColumn("status", F.lit("active"))
    return memory.synced("decision", here, there)[1]


@query("""WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'gotcha' WHEN 1 THEN 'todo' ELSE 'workflow' END AS category, p_name AS content FROM part), h AS (SELECT *, category || ':' || lower(trim(content)) AS k FROM n WHERE id % 3 <> 1 AND id % 5 <> 0), t AS (SELECT DISTINCT category || ':' || lower(trim(content)) AS k FROM n WHERE id % 7 <> 0 AND category <> 'todo')
SELECT 'memory' AS kind, (SELECT count(*) FROM t WHERE k NOT IN (SELECT k FROM h)) AS imported, (SELECT count(*) FROM h WHERE k NOT IN (SELECT k FROM t)) AS exported""")
def b1_sync_memories(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "gotcha").when(F.col("p_partkey") % 3 == 1, "todo").otherwise("workflow")
    n = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("category"), F.col("p_name").alias("content"))
    return memory.synced("memory", n.where("id % 3 <> 1 AND id % 5 <> 0"), n.where("id % 7 <> 0"))[1]


@query("SELECT * FROM (VALUES ('alias', 'auth', 'login', NULL, 3, 7::BIGINT), ('layer', 'svc', NULL, 'svc/', 5, 2), ('convention', 'names', NULL, NULL, 1, 0)) AS v(kind, name, target, pattern, weight, used)"
       + " UNION ALL SELECT 'layer', 'lang ' || lang, 'locale', lang, 2, count(*) FROM documents GROUP BY lang")
def r1_learned_rules(spark, sf_dir):
    rules = spark.createDataFrame([("alias", "old", None, "x", 3, 9), ("alias", "auth", None, "signin", 3, 5)], "kind string, name string, pattern string, target string, weight int, used long")
    rules = memory.taught(rules, "layer", "svc", "svc/", 9)
    rules = memory.taught(memory.taught(rules, "convention", "names", weight=-4), "alias", "auth", target="login")
    docs = t.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("lang "), F.col("lang"))
    own = docs.select("lang").distinct().select(F.lit("layer").alias("kind"), name.alias("name"), F.col("lang").alias("pattern"), F.lit("locale").alias("target"), F.lit(2).alias("weight"), F.lit(0).cast("long").alias("used"))
    rules = rules.unionByName(own)
    uses = spark.createDataFrame([("svc",)] * 2 + [("auth",)] * 7, "name string").unionAll(docs.select(name))
    return memory.listed(memory.touched(memory.forgotten(rules, "old"), uses)).select("kind", "name", "target", "pattern", "weight", "used")


@query("""WITH s AS (SELECT DISTINCT conv_id FROM conversations), f AS (SELECT conv_id, role AS section, lpad(turn::VARCHAR, 5, '0') AS o, left(text, 80) AS t FROM conversations),
c AS (SELECT user_id AS conv_id, 'files' AS section, event_type AS o, event_type AS t FROM events WHERE user_id IN (SELECT conv_id FROM s))
SELECT conv_id AS session, section, count(*) AS n, array_to_string(list_transform((list_sort(list_distinct(list({'o': o, 't': t}))))[1:20], lambda x: x.t), '; ') AS text FROM (SELECT * FROM f UNION ALL SELECT * FROM c) GROUP BY ALL""")
def n2_briefing(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations")
    facts = c.select(F.col("conv_id").alias("session"), F.col("role").alias("kind"), F.lpad(F.col("turn").cast("string"), 5, "0").alias("at"), "text")
    changes = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("path"))
    none = spark.createDataFrame([], "session long, title string")
    return memory.briefing(c.select(F.col("conv_id").alias("session")).distinct(), facts, changes, none)
