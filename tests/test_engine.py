import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, context, graph, memory, paths, quality, text
from tessera.plans import cypher
from tessera.sources import manifests, tree
from tessera.streaming import events


@pytest.fixture(scope="module")
def m1(spark):
    nodes = spark.createDataFrame([(x, "function", x, x, f"/src/{x}.ts", 1, 9, f"fn {x}()", "public", True, False) for x in "abcde"], "id string, type string, name string, qualifiedName string, filePath string, startLine int, endLine int, signature string, visibility string, isExported boolean, isAsync boolean")
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("a", "d", "imports"), ("d", "d", "calls")], "sourceId string, targetId string, type string")
    return nodes, edges


def scores(df):
    return {r.id: round(r.score, 6) for r in df.collect()}


def test_pagerank(spark, m1):
    assert scores(graph.pagerank(*m1, rounds=5, eps=0)) == pytest.approx({"a": 0.292819, "b": 0.206702, "c": 0.247432, "d": 0.179976, "e": 0.073071}, abs=2e-6)
    seeded = scores(graph.pagerank(*m1, seeds=spark.createDataFrame([("d",)], "id string"), rounds=6))
    assert seeded == pytest.approx({"a": 0.234644, "b": 0.170897, "c": 0.205354, "d": 0.329013, "e": 0.060092}, abs=0.02)  # its fixed point
    assert sum(seeded.values()) == pytest.approx(1, abs=1e-5)


def test_reachability(spark, m1):
    seed = lambda x: spark.createDataFrame([(x,)], "id string")
    assert {r.id for r in graph.blast_radius(m1[1], seed("a")).collect()} == {"b", "c"}
    assert {(r.id, r.depth) for r in graph.blast_radius(m1[1], seed("d"), 2).collect()} == {("a", 1), ("c", 2)}
    pairs = spark.createDataFrame([("a", "d"), ("d", "a"), ("e", "e")], "a string, b string")
    got = paths.shortest_paths(graph.arcs(m1[1], ["calls", "imports"]), pairs).collect()
    assert {(r.a, r.b, tuple(r.path)) for r in got} == {("a", "d", ("a", "d")), ("e", "e", ("e",))}
    assert {r.id for r in graph.dead_code(*m1).collect()} == {"e"}
    assert {(r.id, r.component) for r in graph.strongly_connected(graph.arcs(m1[1], ["calls"])).collect()} == {(x, "a") for x in "abc"}


@pytest.mark.parametrize("text_", ["CREATE (n)", "MATCH (f:Nope) RETURN f.name", "MATCH (f) RETURN f", "MATCH (f) RETURN f.name SKIP 1", "MATCH (f) WHERE f.name = 'x RETURN f.name", "MATCH (f) RETURN f.nope", "MATCH (f) RETURN g.name"])
def test_queries_that_are_refused(m1, text_):
    with pytest.raises(cypher.CypherError):
        cypher.run(text_, *m1)


def test_queries_that_are_taken(m1):
    run = lambda q, **k: sorted(tuple(r) for r in cypher.run(q, *m1, **k).collect())
    assert run("MATCH (f:Function) RETURN f.name LIMIT 10") == [(x,) for x in "abcde"]
    assert run("MATCH (a)-[e:CALLS]->(b) RETURN a.name, b.name, e.type") == [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("d", "d", "calls")]
    with pytest.raises(cypher.CypherError):
        cypher.run("MATCH (a)-[e:CALLS]->(b) RETURN a.name", *m1, strict=True)
    assert run("MATCH (a)-[:CALLS]-(b) WHERE a.name = 'd' RETURN b.name") == [("d",)]
    assert run("MATCH (f:Function) WHERE NOT EXISTS { (f)<-[:CALLS]-() } RETURN f.name") == [("e",)]
    assert run("MATCH (f) WHERE f.name IN [] OR (NOT EXISTS { (f)-[:CALLS]->() } AND f.name STARTS WITH 'E') RETURN f.name AS n") == [("e",)]
    assert run("MATCH (f) WHERE f.name = NULL RETURN f.name") == []
    assert run("MATCH (a)-[:CALLS]->(b)<-[:CALLS]-(c) WHERE NOT (a.name = 'x' OR b.isAsync = true) RETURN DISTINCT a.name AS n ORDER BY a.name DESC LIMIT 2") == [("c",), ("d",)]


def test_token_estimates(spark):
    want = {"": 0, "hi": 1, "abcd": 1, "hello world": 3, "foo bar baz": 4, "hello world foo bar": 5, "     ": 0, "word " * 10_000: 13_000, "function foo(a: string, b: number): boolean { return a.length > b; }": 30}
    got = spark.createDataFrame([(x,) for x in want], "t string").select("t", context.estimate_tokens(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == want


def test_content_types(spark):
    want = {"diff --git a b": "diff", "Error: x\n    at f (a.js:1:2)": "stack_trace", "PASS a.test.ts": "test_output", "error: no such file": "build_log", '{"a": 1}': "json_data", "key = value": "config_file", "# Title\n\ntext": "markdown", "import os\nprint(1)": "source_code", "just words": "plain_text", "  ": "plain_text"}
    got = spark.createDataFrame([(x,) for x in want], "t string").select("t", context.content_type(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == want


def test_okapi(spark):
    docs = spark.createDataFrame([("n1", ["save", "user"]), ("n2", ["save", "save", "file"]), ("n3", ["load", "user"])], "doc string, w array<string>")
    got = {r.doc: round(r.score, 6) for r in text.okapi(docs, F.col("w"), ["save", "user"]).collect()}
    assert got == {"n1": 2.124138, "n2": 1.272727, "n3": 1.062069}
    words = spark.createDataFrame([("getHTTPResponse2xx_fooBar a",)], "t string").select(text.code_tokens(F.col("t")).alias("w")).first().w
    assert words == ["get", "http", "response", "xx", "foo", "bar"]


def test_collapse_and_decay(spark):
    runs = [(["created", "deleted"], ""), (["created", "modified"], "created"), (["modified", "deleted"], "deleted"), (["deleted", "created"], "modified"), (["modified", "modified"], "modified"), (["created", "deleted", "created"], "created")]
    rows = [(k, i, i, kind) for k, (kinds, _) in enumerate(runs) for i, kind in enumerate(kinds)]
    got = {r.k: r.state for r in changes.collapse(spark.createDataFrame(rows, "k int, ts int, id int, kind string"), ["k"]).collect()}
    assert got == {k: s for k, (_, s) in enumerate(runs) if s}
    for kinds, want in runs:
        state = ""
        for kind in kinds:
            state = events.next_state(state, kind)
        assert state == want
    assert round(spark.range(1).select(memory.decayed(F.lit(0.9), F.lit(30.0)).alias("x")).first().x, 6) == 0.193175


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"path": f"p{i % 5}", "ts": i, "id": i, "kind": ["created", "modified", "deleted"][(i * 7) % 3]} for i in range(60)]
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[30 * k : 30 * (k + 1)]))
    stream = spark.readStream.schema("path string, ts long, id long, kind string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {}

    def take(df, _):
        got.update({r.path: r.state for r in df.collect()})

    events.collapse_stream(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    want = {r.path: r.state for r in changes.collapse(spark.createDataFrame(rows, "path string, ts long, id long, kind string"), ["path"]).collect()}
    assert {k: v for k, v in got.items() if v} == want


def test_complexity_and_layers(spark):
    code = "function f(a) {\n  if (a && b) {\n    for (x of a) {\n      y = x ? 1 : 2;\n    }\n  }\n  // if comment\n}"
    r = quality.health(quality.complexity(spark.createDataFrame([(1, code)], "doc int, text string"))).first()
    assert (r.cyclomatic, r.cognitive, r.nesting, r.health, r.risk) == (5, 6, 3, 10, "low")
    got = {r.path: (r.layer, r.confidence) for r in quality.layers(spark.createDataFrame([("/src/services/userService.ts",), ("/x",)], "path string")).collect()}
    assert got == {"/src/services/userService.ts": ("service", 100), "/x": ("unknown", 0)}


def test_source_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("function no() {}")
    (tmp_path / "pkg" / "shop.py").write_text("import os\nfrom util import tax\n\nRATE = 1\n\nclass Shop(Base):\n    def __init__(self):\n        self.total = tax(1)\n\n    async def _sell(self):\n        return helper()\n\ndef helper():\n    return 1\n")
    (tmp_path / "pkg" / "util.py").write_text("def tax(x):\n    return x\n\nclass Base:\n    pass\n")
    (tmp_path / "pkg" / "app.ts").write_text("import { a } from './lib';\nexport class App {\n  private run(x: number) {\n    return start(x);\n  }\n}\nexport async function start(x) {\n  return x;\n}\n")
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"left": "^1.0"}, "devDependencies": {"right": "2"}}))
    (tmp_path / "empty.py").write_text("")
    (tmp_path / ".gitignore").write_text("# left out\n*.gen.py\n/top.py\nlogs/\n!keep.gen.py\n")
    (tmp_path / "pkg" / ".gitignore").write_text("own.py\n")
    (tmp_path / "pkg" / "logs").mkdir()
    for gone in ("a.gen.py", "top.py", "pkg/own.py", "pkg/logs/l.py"):
        (tmp_path / gone).write_text("def left_out():\n    pass\n")
    for kept in ("keep.gen.py", "pkg/top.py", "own.py"):
        (tmp_path / kept).write_text("def stays():\n    pass\n")
    nodes, edges = tree.index(spark, str(tmp_path))
    nodes, edges = nodes.cache(), edges.cache()
    names = {(r.name, r.type): r for r in nodes.collect()}
    assert {("helper", "function"), ("Shop", "class"), ("_sell", "method"), ("__init__", "constructor"), ("RATE", "constant"), ("App", "class"), ("start", "function"), ("run", "method")} <= set(names)
    assert not any(n in ("no", "left_out") for n, _ in names) and sum(r.name == "stays" for r in nodes.collect()) == 3
    assert names["_sell", "method"].isAsync and names["run", "method"].visibility == "private"
    by_id = {r.id: r.name for r in nodes.collect()}
    got = {(by_id.get(r.sourceId), by_id.get(r.targetId, r.targetId), r.type) for r in edges.collect()}
    assert {("_sell", "helper", "calls"), ("__init__", "tax", "calls"), ("run", "start", "calls"), ("Shop", "Base", "inherits"), ("Shop", "_sell", "contains"), ("shop.py", "util.py", "imports"), ("shop.py", "os", "imports"), ("app.ts", "./lib", "imports")} <= got
    deps = {(r.name, r.version) for r in manifests.dependencies(tree.scan(spark, str(tmp_path))).collect()}
    assert deps == {("left", "^1.0"), ("right", "2")}


def test_similar_pairs_are_all_found(spark):
    import random

    rng = random.Random(2)
    sets = [(i, rng.sample("abcdefghij", rng.randrange(1, 8))) for i in range(80)]
    got = {(r.a, r.b) for r in text.prefix_pairs(spark.createDataFrame(sets, "doc int, w array<string>"), 0.6).collect()}
    assert got == {(i, j) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}


def test_greedy_pack_and_grep(spark):
    items = spark.createDataFrame([("s", 1, 9.0, 60), ("s", 2, 8.0, 70), ("s", 3, 7.0, 30), ("s", 4, 6.0, 12), ("s", 5, 5.0, 5)], "g string, id long, score double, cost long")
    assert [r.id for r in context.greedy_pack(items, 100, "g").collect()] == [1, 3, 5]
    d = spark.createDataFrame([(1, "one\ntwo cats\nthree\ncatalog")], "doc int, text string")
    assert [(r.line_no, r.before, r.after) for r in text.grep(d, "cats?", context=1, whole_word=True).collect()] == [(2, "one", "three")]
