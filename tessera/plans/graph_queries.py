"""Graph and query-language queries over the tables' test graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as t
from tessera.operators import graph as g
from tessera.operators import paths
from tessera.plans import cypher
from tessera.plans.registry import query

WITH, REC = f"WITH {t.CTES}", f"WITH RECURSIVE {t.CTES}"


def _cypher(name: str, text: str, sql: str, project: str | None = None) -> None:
    def run(spark, sf_dir):
        return cypher.run(text, t.nodes(spark, sf_dir), t.edges(spark, sf_dir), project)

    run.__name__ = name
    query(sql)(run)


_cypher("g16_one_hop", "MATCH (a:function)-[:CALLS]->(b:method) WHERE a.name CONTAINS 'RING' RETURN DISTINCT a.name AS name, b.id AS id ORDER BY b.id, a.name LIMIT 200",
        f"{WITH} SELECT DISTINCT a.name AS name, b.id AS id FROM nodes a JOIN edges e ON e.sourceId = a.id JOIN nodes b ON b.id = e.targetId WHERE a.type = 'function' AND b.type = 'method' AND e.type = 'calls' AND lower(a.name) LIKE '%ring%' ORDER BY id, name LIMIT 200")
_cypher("g16_two_hops", "MATCH (r:module)-[:CONTAINS]->(n:namespace)-[:CONTAINS]->(s:interface) RETURN r.name, n.name, s.name AS supplier",
        f"{WITH} SELECT r.name AS r_name, n.name AS n_name, s.name AS supplier FROM nodes r JOIN edges e ON e.sourceId = r.id JOIN nodes n ON n.id = e.targetId JOIN edges f ON f.sourceId = n.id JOIN nodes s ON s.id = f.targetId WHERE r.type = 'module' AND n.type = 'namespace' AND s.type = 'interface' AND e.type = 'contains' AND f.type = 'contains'")
_cypher("g16_left_hop", "MATCH (c:class)<-[:DEPENDS_ON]-(o:method) WHERE c.isExported = true AND o.startLine >= 90 RETURN c.id, o.id AS order_id",
        f"{WITH} SELECT c.id AS c_id, o.id AS order_id FROM nodes c JOIN edges e ON e.targetId = c.id JOIN nodes o ON o.id = e.sourceId WHERE c.type = 'class' AND o.type = 'method' AND e.type = 'depends_on' AND c.isExported AND o.startLine >= 90")
_cypher("g16_undirected", "MATCH (a:namespace)-[:CONTAINS]-(b) WHERE b.type IN ['module', 'interface'] RETURN a.name AS a, b.id AS b",
        f"{WITH} SELECT a.name AS a, b.id AS b FROM nodes a JOIN edges e ON e.type = 'contains' AND (e.sourceId = a.id OR e.targetId = a.id) JOIN nodes b ON b.id = CASE WHEN e.sourceId = a.id THEN e.targetId ELSE e.sourceId END WHERE a.type = 'namespace' AND b.type IN ('module', 'interface')")
_cypher("g16_not_exists", "MATCH (m:method) WHERE NOT EXISTS { (m)<-[:CALLS]-() } RETURN m.id, m.visibility",
        f"{WITH} SELECT m.id AS m_id, m.visibility AS m_visibility FROM nodes m WHERE m.type = 'method' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.targetId = m.id AND e.type = 'calls')")
_cypher("g16_not_exists_or", "MATCH (m:method) WHERE m.name ENDS WITH '77' OR NOT EXISTS { (m)<-[:CALLS]-() } RETURN m.id",
        f"{WITH} SELECT m.id AS m_id FROM nodes m WHERE m.type = 'method' AND (m.name LIKE '%77' OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.targetId = m.id AND e.type = 'calls'))")
_cypher("g16_logic", "MATCH (p:function) WHERE NOT (p.isAsync = true OR p.startLine < 50) AND p.name <> 'x' RETURN p.id, p.endLine",
        f"{WITH} SELECT id AS p_id, endLine AS p_endLine FROM nodes p WHERE type = 'function' AND NOT (isAsync OR startLine < 50) AND name <> 'x'")
_cypher("g16_distinct_order_limit", "MATCH (p:function)-[:IMPORTS]->(s:interface) RETURN DISTINCT s.name AS supplier ORDER BY s.startLine DESC, s.name LIMIT 40",
        f"{WITH} SELECT s.name AS supplier FROM nodes s WHERE s.type = 'interface' AND EXISTS (SELECT 1 FROM edges e JOIN nodes p ON p.id = e.sourceId WHERE e.targetId = s.id AND e.type = 'imports' AND p.type = 'function') ORDER BY s.startLine DESC, s.name LIMIT 40")
_cypher("g16_star", "MATCH (n:namespace) RETURN n.*", f"{WITH} SELECT id AS n_id, type AS n_type, name AS n_name, qualifiedName AS n_qualifiedName, filePath AS n_filePath, startLine AS n_startLine, endLine AS n_endLine, signature AS n_signature, language AS n_language, visibility AS n_visibility, isAsync AS n_isAsync, isStatic AS n_isStatic, isExported AS n_isExported FROM nodes WHERE type = 'namespace'")
_cypher("p6_project_scope", "MATCH (c)-[:CONTAINS]->(x:class) RETURN x.id", f"{WITH} SELECT x.id AS x_id FROM nodes c JOIN edges e ON e.sourceId = c.id JOIN nodes x ON x.id = e.targetId WHERE e.type = 'contains' AND x.type = 'class' AND c.filePath LIKE '/src/region1%'", "/src/region1")


def _seed(spark, *ids):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("id"))


@query(f"{WITH} SELECT n.id, n.name FROM nodes n JOIN edges e ON e.sourceId = n.id WHERE e.targetId = 'o:1' AND e.type = 'calls'")
def g1_callers(spark, sf_dir):
    return g.callers(t.nodes(spark, sf_dir), t.edges(spark, sf_dir), "o:1").select("id", "name")


@query(f"{WITH} SELECT n.id, n.name FROM nodes n JOIN edges e ON e.targetId = n.id WHERE e.sourceId = 'p:1' AND e.type = 'calls'")
def g1_callees(spark, sf_dir):
    return g.callees(t.nodes(spark, sf_dir), t.edges(spark, sf_dir), "p:1").select("id", "name")


def _recursive(moves: str, seed: str, depth: int) -> str:
    return f"{REC}, moves AS ({moves}), walk(id, depth) AS (SELECT '{seed}', 0 UNION SELECT m.dst, w.depth + 1 FROM walk w JOIN moves m ON m.src = w.id WHERE w.depth < {depth}) SELECT id, min(depth)::INTEGER AS depth FROM walk WHERE id <> '{seed}' GROUP BY id"


_DEPENDS = "SELECT targetId AS src, sourceId AS dst FROM edges WHERE type IN ('calls', 'imports', 'inherits', 'implements', 'uses', 'depends_on')"


@query(_recursive("SELECT sourceId AS src, targetId AS dst FROM edges WHERE type = 'contains'", "r:1", 3))
def g3_descendants(spark, sf_dir):
    return g.descendants(t.edges(spark, sf_dir, repeats=True), _seed(spark, "r:1"), 3).select("id", "depth")


@query(_recursive("SELECT targetId AS src, sourceId AS dst FROM edges WHERE type = 'contains'", "s:1", 10))
def g2_ancestors(spark, sf_dir):
    return g.ancestors(t.edges(spark, sf_dir, repeats=True), _seed(spark, "s:1")).select("id", "depth")


@query(_recursive(_DEPENDS, "c:1", 3))
def g4_blast_radius(spark, sf_dir):
    return g.blast_radius(t.edges(spark, sf_dir, repeats=True), _seed(spark, "c:1"), 3).select("id", "depth")


@query(f"SELECT depth, count(*) AS n FROM ({_recursive(_DEPENDS, 'c:2', 4)}) GROUP BY depth")
def g19_layered_impact(spark, sf_dir):
    return g.layered_impact(t.edges(spark, sf_dir, repeats=True), _seed(spark, "c:2"), 4).select("depth", "n")


@query(f"SELECT 'o:3' AS seed, (SELECT count(*) FROM lineitem_calls) AS direct_callers, (SELECT count(*) FROM walked) AS affected, CASE WHEN (SELECT count(*) FROM walked) > 20 THEN 'high' WHEN (SELECT count(*) FROM walked) > 5 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT 1)".replace("lineitem_calls", "(SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey = 3)").replace("walked", f"({_recursive(_DEPENDS, 'o:3', 2)})"))
def g8_impact(spark, sf_dir):
    return g.impact(t.edges(spark, sf_dir), _seed(spark, "o:3"), 2)


_PAIRS = ("p:1", "p:2", "p:3", "p:50", "p:100", "p:150")


@query(f"""{REC}, moves AS (SELECT DISTINCT sourceId AS src, targetId AS dst FROM edges WHERE type = 'uses'),
walk(id, length, path) AS (SELECT 'p:1', 0, ['p:1'] UNION ALL SELECT dst, length + 1, min(list_append(path, dst)) FROM walk JOIN moves ON src = id WHERE length < 4 GROUP BY dst, length)
SELECT 'p:1' AS a, id AS b, min(length)::INTEGER AS length, array_to_string(min_by(path, length), ' ') AS path FROM walk WHERE id IN {_PAIRS} GROUP BY id""")
def g5_shortest_path(spark, sf_dir):
    """The paths themselves; of several shortest ones the least."""
    pairs = _seed(spark, *_PAIRS).select(F.lit("p:1").alias("a"), F.col("id").alias("b"))
    return paths.shortest_paths(g.arcs(t.edges(spark, sf_dir), ["uses"]), pairs, 4).select("a", "b", "length", F.array_join("path", " ").alias("path"))


def _rank_sql(rounds: int, jump: str) -> str:
    steps = ""
    for i in range(1, rounds + 1):
        steps += f", r{i} AS (SELECT b.id, b.dangling, b.jump, (0.15 + 0.85 * (SELECT coalesce(sum(score), 0) FROM r{i - 1} WHERE dangling)) * b.jump + 0.85 * coalesce(g.got, 0) AS score FROM base b LEFT JOIN (SELECT l.dst, sum(r.score * l.share) AS got FROM links l JOIN r{i - 1} r ON r.id = l.src GROUP BY l.dst) g ON g.dst = b.id)"
    return f"""{WITH}, ids AS (SELECT id, name FROM nodes WHERE type = 'function'),
w AS (SELECT sourceId AS src, targetId AS dst, 0.7::DOUBLE AS w FROM edges WHERE type = 'uses' AND sourceId <> targetId),
links AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w),
base AS (SELECT i.id, ({jump})::DOUBLE AS jump, i.id NOT IN (SELECT src FROM w) AS dangling FROM ids i),
r0 AS (SELECT *, jump AS score FROM base){steps}
SELECT id, round(score / (SELECT sum(score) FROM r{rounds}), 6) AS score FROM r{rounds}"""


def _functions(spark, sf_dir):
    return t.nodes(spark, sf_dir).where("type = 'function'"), t.edges(spark, sf_dir).where("type = 'uses'")


@query(_rank_sql(5, "1.0 / (SELECT count(*) FROM ids)"))
def g10_pagerank(spark, sf_dir):
    return g.pagerank(*_functions(spark, sf_dir), rounds=5, eps=0.0).select("id", F.round("score", 6).alias("score"))


@query(_rank_sql(5, "CASE WHEN i.id IN (SELECT 'p:' || p_partkey FROM part WHERE p_brand = 'Brand#11') THEN 0.5 / (SELECT count(*) FROM part WHERE p_brand = 'Brand#11') ELSE 0.5 / (SELECT count(*) FROM part WHERE p_brand <> 'Brand#11') END"))
def g11_personalized_pagerank(spark, sf_dir):
    nodes, edges = _functions(spark, sf_dir)
    return g.pagerank(nodes, edges, rounds=5, eps=0.0, seeds=nodes.where("filePath = '/lib/Brand#11.go'")).select("id", F.round("score", 6).alias("score"))


_DEGREE_RANK = f"{WITH}, d AS (SELECT id, count(*)::DOUBLE AS score FROM (SELECT sourceId AS id FROM edges UNION ALL SELECT targetId FROM edges) GROUP BY id)"
_RANKED = _rank_sql(5, "1.0 / (SELECT count(*) FROM ids)").replace("round(score / (SELECT sum(score) FROM r5), 6)", "round(score / (SELECT sum(score) FROM r5), 9)")


def _ranks(spark, sf_dir):
    return g.pagerank(*_functions(spark, sf_dir), rounds=5, eps=0.0).select("id", F.round("score", 9).alias("score"))


@query(f"SELECT id, filePath, position::INTEGER AS position FROM (SELECT n.id, n.filePath, row_number() OVER (PARTITION BY n.filePath ORDER BY d.score DESC, n.id) AS position FROM ({WITH} SELECT * FROM nodes) n JOIN ({_RANKED}) d USING (id)) WHERE position <= 10")
def o7_table_of_contents(spark, sf_dir):
    return g.table_of_contents(t.nodes(spark, sf_dir), _ranks(spark, sf_dir)).select("id", "filePath", "position")


@query(f"SELECT n.id, n.type FROM ({WITH} SELECT * FROM nodes) n JOIN ({_RANKED}) d USING (id) ORDER BY d.score DESC, n.id LIMIT 25")
def o3_top_ranked(spark, sf_dir):
    return g.top_ranked(t.nodes(spark, sf_dir), _ranks(spark, sf_dir), 25).select("id", "type")


@query(f"""{REC}, m AS (SELECT DISTINCT sourceId AS src, targetId AS dst FROM edges WHERE type = 'uses' AND sourceId <> targetId),
reach AS (SELECT src AS a, dst AS b FROM m UNION SELECT a, dst FROM reach JOIN m ON src = b),
mutual AS (SELECT x.a AS id, x.b AS other FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a)
SELECT id, component FROM (SELECT id, least(id, min(other)) AS component, count(*) FILTER (other <> id) AS n FROM mutual GROUP BY id) WHERE n > 0""")
def g17_strongly_connected(spark, sf_dir):
    return g.strongly_connected(g.arcs(t.edges(spark, sf_dir, repeats=True), ["uses"]))


_LONGEST_CYCLE = 4


@query(f"""{REC}, m AS (SELECT DISTINCT sourceId AS src, targetId AS dst FROM edges WHERE type = 'uses' AND sourceId <> targetId),
walk(least, id, length, path) AS (SELECT src, dst, 1, [src, dst] FROM m WHERE dst > src UNION ALL SELECT least, dst, length + 1, min(list_append(path, dst)) FROM walk JOIN m ON src = id WHERE length < {_LONGEST_CYCLE - 1} AND dst > least GROUP BY least, dst, length),
closed AS (SELECT least, length + 1 AS length, min(path) AS cycle FROM walk JOIN m ON src = id AND dst = least GROUP BY least, length),
first AS (SELECT least, min(length) AS length, min_by(cycle, length) AS cycle FROM closed GROUP BY least)
SELECT min_by(least, cycle) AS least, min(length)::INTEGER AS length, array_to_string(min(cycle), ' ') AS cycle FROM first GROUP BY list_sort(cycle)""")
def g17_cycles(spark, sf_dir):
    """Of each symbol the shortest cycle of uses in which it is the least, up to a length."""
    moves = g.arcs(t.edges(spark, sf_dir), ["uses"])
    return paths.cycles(moves, _LONGEST_CYCLE, g.strongly_connected(moves)).select("least", "length", F.array_join("cycle", " ").alias("cycle"))


_DEAD = f"{WITH}, dead AS (SELECT n.id, n.filePath, CASE WHEN regexp_matches(lower(n.filePath), '{g.TEST_FILES}') THEN 'low_confidence' WHEN n.isExported THEN 'possibly_dead' WHEN n.visibility IN ('private', 'protected') OR NOT regexp_matches(lower(n.filePath), '{g.ENTRY_FILES}') THEN 'definitely_dead' ELSE 'possibly_dead' END AS confidence FROM nodes n WHERE n.type IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.type = 'calls' AND e.targetId = n.id))"


@query(f"{_DEAD} SELECT id, filePath, confidence FROM dead")
def g13_dead_code(spark, sf_dir):
    return g.dead_code(t.nodes(spark, sf_dir), t.edges(spark, sf_dir)).select("id", "filePath", "confidence")


@query(f"{_DEAD} SELECT confidence, count(*) AS n, floor(count(*) * 10000.0 / (SELECT count(*) FROM dead) + 0.5) / 100 AS percentage FROM dead GROUP BY confidence")
def a2_dead_code_summary(spark, sf_dir):
    return g.dead_code_summary(g.dead_code(t.nodes(spark, sf_dir), t.edges(spark, sf_dir)))


@query(f"{_DEGREE_RANK} SELECT n.id, d.score::BIGINT AS total FROM nodes n JOIN d USING (id) ORDER BY d.score DESC, n.id LIMIT 10")
def a4_hotspots(spark, sf_dir):
    return g.hotspots(t.nodes(spark, sf_dir), t.edges(spark, sf_dir)).select("id", "total")


@query(f"{WITH}, b AS (SELECT DISTINCT * FROM (SELECT sourceId AS id, targetId AS other FROM edges UNION ALL SELECT targetId, sourceId FROM edges) WHERE id <> other), top AS (SELECT id FROM b GROUP BY id ORDER BY count(*) DESC, id LIMIT 120) SELECT sourceId, targetId, type FROM edges WHERE sourceId IN (SELECT id FROM top) AND targetId IN (SELECT id FROM top)")
def s22_top_degree_graph(spark, sf_dir):
    edges = t.edges(spark, sf_dir)
    return g.induced(edges, g.neighbour_degree(edges).orderBy(F.desc("neighbours"), "id").limit(120)).select("sourceId", "targetId", "type")


@query(f"{WITH}, a AS (SELECT 'src:' || row_number() OVER () AS x) SELECT sourceId, targetId, type FROM edges WHERE (sourceId NOT IN (SELECT id FROM nodes WHERE type <> 'namespace') OR targetId NOT IN (SELECT id FROM nodes WHERE type <> 'namespace'))".replace(", a AS (SELECT 'src:' || row_number() OVER () AS x)", ""))
def s12_orphan_edges(spark, sf_dir):
    return g.orphan_edges(t.nodes(spark, sf_dir).where("type <> 'namespace'"), t.edges(spark, sf_dir))


@query(f"{WITH}, c AS (SELECT * FROM edges WHERE type = 'calls'), d AS (SELECT id, sum(o) AS o, count(*) AS n FROM (SELECT sourceId AS id, 1 AS o FROM c UNION ALL SELECT targetId, 0 FROM c) GROUP BY id) SELECT n.id FROM nodes n JOIN d USING (id) WHERE n.type IN ('function', 'method') AND (d.o >= 8 OR d.n >= 12)")
def g18_god_functions(spark, sf_dir):
    return g.god_functions(t.nodes(spark, sf_dir), t.edges(spark, sf_dir)).select("id")


_MODULES = f"{WITH}, m AS (SELECT id, filePath AS module FROM nodes)"


def _modules(spark, sf_dir):
    return t.nodes(spark, sf_dir).select("id", F.col("filePath").alias("module"))


@query(f"{_MODULES} SELECT a.module AS source, b.module AS target, e.type, count(*) AS n FROM edges e JOIN m a ON a.id = e.sourceId JOIN m b ON b.id = e.targetId WHERE a.module <> b.module GROUP BY ALL")
def j16_module_relations(spark, sf_dir):
    return g.module_relations(t.edges(spark, sf_dir), _modules(spark, sf_dir))


@query(f"{_MODULES}, x AS (SELECT DISTINCT a.module AS s, b.module AS d FROM edges e JOIN m a ON a.id = e.sourceId JOIN m b ON b.id = e.targetId WHERE a.module <> b.module), k AS (SELECT DISTINCT module FROM m), y AS (SELECT module, (SELECT count(*) FROM x WHERE d = module) AS ca, (SELECT count(*) FROM x WHERE s = module) AS ce FROM k) SELECT *, CASE WHEN ca + ce > 0 THEN ce / (ca + ce) ELSE 0.5 END AS instability FROM y")
def a21_instability(spark, sf_dir):
    return g.instability(t.edges(spark, sf_dir), _modules(spark, sf_dir))


@query(f"{WITH} SELECT 'node' AS what, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'language', language, count(*) FROM nodes GROUP BY language")
def a1_graph_stats(spark, sf_dir):
    n, e = t.nodes(spark, sf_dir), t.edges(spark, sf_dir)
    one = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return one(n, "node", "type").unionAll(one(e, "edge", "type")).unionAll(one(n, "language", "language"))


@query(f"SELECT id, depth FROM ({_recursive(_DEPENDS, 'c:1', 3)}) ORDER BY depth, id LIMIT 40")
def o9_nearest_reached(spark, sf_dir):
    return g.first_reached(g.blast_radius(t.edges(spark, sf_dir, repeats=True), _seed(spark, "c:1"), 3), 40).select("id", "depth")


@query(f"{WITH} SELECT (SELECT count(*) FROM nodes) || ':' || (SELECT count(*) FROM edges) AS key")
def g12_rank_key(spark, sf_dir):
    return g.rank_key(t.nodes(spark, sf_dir), t.edges(spark, sf_dir), compat=True)


@query(f"{WITH}, f AS (SELECT filePath, count(*) FILTER (type IN ('function', 'method')) AS n, max(endLine) AS l, max(isExported::INT) AS e FROM nodes GROUP BY filePath), x AS (SELECT a.filePath AS p, b.filePath AS q FROM edges e JOIN nodes a ON a.id = e.sourceId JOIN nodes b ON b.id = e.targetId WHERE e.type = 'imports' AND a.filePath <> b.filePath) SELECT filePath, 'large' AS smell FROM f WHERE n > 15 OR l > 300 UNION ALL SELECT filePath, 'no exports' FROM f WHERE e = 0 UNION ALL SELECT filePath, 'orphan' FROM f WHERE filePath NOT IN (SELECT p FROM x UNION SELECT q FROM x)")
def g18_file_smells(spark, sf_dir):
    from tessera.operators import report

    return report.file_smells(t.nodes(spark, sf_dir), t.edges(spark, sf_dir).where("type = 'imports'"))
