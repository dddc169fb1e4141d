import pytest
from pyspark.sql import functions as F

from tessera.operators import alike, budget, compress, context, flow, graph, memory, quality, report, search, store, text
from tessera.plans import text_queries
from tessera.plans.registry import ORACLES


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- words and search


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("effective", "effect"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky"), ("étés", "étés")])
def test_stems(word, want):
    assert search.stem(word) == want


def test_index_is_saved_replaced_and_searched(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Running tests, café", "work"), (2, "run away", "run"), (3, None, None), (4, "nothing", "here")], "doc long, content string, category string").withColumn("tags", F.array(F.lit("Tag")))
    ix = search.note_index(docs)
    assert {r.doc for r in search.matches(ix, ["runs"], "any").collect()} == {1, 2}
    assert {r.doc for r in search.matches(ix, ["test", "run"], "all").collect()} == {1}
    scores = {r.doc: r.score for r in search.ranked(ix, ["run"], search.NOTE_WEIGHTS, "any").collect()}
    assert set(scores) == {1, 2} and all(s > 0 for s in scores.values())
    ix.save(str(tmp_path))
    again = search.Index.load(spark, str(tmp_path), stemmed=True)
    assert again.fields == ["content", "category", "tags"] and {r.doc for r in search.matches(again, ["cafe"], "any").collect()} == {1}
    new = search.note_index(spark.createDataFrame([(2, "walk", "x")], "doc long, content string, category string").withColumn("tags", F.array(F.lit("t"))))
    assert {r.doc for r in search.matches(again.replace(new), ["run"], "any").collect()} == {1}
    assert {r.doc for r in search.matches(ix, ["noth"], "prefix").collect()} == {4} and search.matches(ix, [], "any").count() == 0


def test_snippets(spark):
    t = spark.createDataFrame([(" ".join(f"w{i}" for i in range(60)) + " Hit, " + " ".join(f"v{i}" for i in range(60)),), ("hit me",), ("none",)], "t string")
    got = [r.s for r in t.select(search.snippet(F.col("t"), ["hit"], 10).alias("s")).collect()]
    assert got[0] == "...w55 w56 w57 w58 w59 >>>Hit,<<< v0 v1 v2 v3..." and got[1] == ">>>hit<<< me" and got[2] == "none"


# --- budgets and compression


def test_estimates_agree(spark):
    texts = ["", "hi", "    ", "hello, world! foo(bar)", "café 日本語 text", "a" * 300, "x-y = {1: 'z'}"]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", context.estimate_tokens(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: budget.estimate(t) for t in texts}


def test_texts_are_cut_to_fit():
    text = "\n\n".join(f"Paragraph {i} says a few words, and some more." for i in range(40))
    short = budget.cut_to(text, 120)
    assert budget.estimate(short) <= 120 and short.endswith(budget.TAIL) and short.removesuffix(budget.TAIL).endswith(".")
    assert budget.cut_to(text, 10_000) == text and budget.cut_to(text, 0) == budget.TAIL and budget.cut_to("word " * 500, 3) == budget.TAIL


def test_budgets_are_moved_to_who_needs_them(spark):
    b = budget.Budgets({"graphResults": 100, "changeSummary": 1000}, 1100)
    b.record("graphResults", 150)
    b.record("changeSummary", 200)
    b.reallocate()
    assert b.now == {"graphResults": 120, "changeSummary": 220} and b.left("changeSummary") == 20 and b.left() == 750
    assert b.enforce("graphResults", "x") == "[Graph Results: budget exhausted]"
    b.naive = 700
    assert b.saved_percent() == 50 and b.report(spark).count() == 3
    lines = spark.createDataFrame([(i, f"symbol {i}") for i in range(50)], "order int, line string")
    files = spark.createDataFrame([(1, "a.py", "x = 1\n" * 5), (2, "b.py", "y = 2\n" * 20_000)], "order int, path string, text string")
    got = {r.section: r for r in budget.package(spark, {"name": "p", "tree": "src"}, symbols=lines, files=files).collect()}
    assert got["Project Overview"].text.startswith("# p\n\n## Structure\nsrc") and got["Relevant Symbols"].tokens <= 10_000 and got["a.py"].tier == 3
    assert sum(r.tokens for r in got.values()) <= budget.TOTAL


def test_every_type_is_told_and_shortened(spark):
    d = spark.createDataFrame(list(text_queries.SAMPLES.items()), "name string, text string")
    got = {r.name: r for r in d.select("name", context.content_type(F.col("text")).alias("kind"), *(compress.compress(F.col("text"), F.col("name"), x).alias(x) for x in ("minimal", "moderate", "aggressive"))).collect()}
    assert all(r.kind == n for n, r in got.items())
    assert got["build_log"].moderate == "=== Errors & Warnings ===\nstart\nwarning: unused x\nerror: no such file\ndone".replace("start\n", "").replace("\ndone", "")
    assert got["build_log"].aggressive == "=== Errors ===\nerror: no such file"
    assert got["test_output"].moderate == "=== Failures (1) ===\nFAIL b.test.ts\n  Expected 1\n  Received 2\n\n=== Summary ===\nTests: 1 failed, 1 passed"
    assert got["stack_trace"].moderate == "Error: no\n    at f (/src/a.js:1:2)\n    ... 2 framework frames\n    at f (/src/a.js:1:2)"
    assert got["stack_trace"].aggressive == "Error: no\n    at f (/src/a.js:1:2)\n    ... 2 framework frames"
    assert "// ... 3 more items" in got["json_data"].moderate and '"c": {' in got["json_data"].moderate
    assert got["markdown"].moderate == "# Title\n\nSome *text* with a link.\n\n### Deep" and got["markdown"].aggressive == "# Title\n\nSome text with .\n\n## Deep"
    assert got["diff"].moderate.split("\n")[4:] == ["  ... 1 unchanged lines", " two", " three", "-four", "+FOUR", "  ... 1 unchanged lines", " six", " seven"]
    assert got["config_file"].aggressive == "[Config structure — 4 entries]\n[main]\nkey: <string>\nflag: <boolean>\nport: <number>"
    assert got["source_code"].aggressive == "import os\nfunction f(a) { ... }\nexport class A {\n  run() { ... }\n}"
    assert got["plain_text"].aggressive == "Just words.\n\nA second paragraph." and compress.compressed("  ", "diff", "moderate") == ""


def test_signs_of_types_one_by_one(spark):
    """A text of each pattern is of its type."""
    lines = {
        "diff": ["diff --git a b", "--- a/x", "+++ b/x", "@@ -1,2 +1 @@"], "stack_trace": ["x\n at f (a.js:1:2)", 'x\n  File "a.py", line 3', "x\n at f(A.java:3)", "Traceback (most recent call last)", "panic: boom goroutine 1"],
        "test_output": ["ok 1", "12 passed", "RUNS a", "✓ works", "x FAILED [ 10%]", "=== FAILURES ==="], "build_log": ["Note: x", "[10:20:30] x", "> npm test", "BUILD FAILED", "x error TS12: y"], "json_data": ['{"a": [1]}'],
        "config_file": ["[a.b]", "a.b: c", "kind: x"], "markdown": ["## x", "x y\n---"], "source_code": ["use strict", "fn main", "static x", "x y;", "  // x y"], "plain_text": ["x y", "", "(a)"],
    }
    cases = [(kind, line) for kind, some in lines.items() for line in some]
    got = spark.createDataFrame(cases, "kind string, t string").select("kind", "t", context.content_type(F.col("t")).alias("k")).collect()
    assert [(r.kind, r.t) for r in got if r.k != r.kind] == []


# --- snapshots


def test_snapshots_are_published_whole(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "f"), ("b", "g")], "id string, filePath string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "x", "calls")], "sourceId string, targetId string, type string")
    store.publish(spark, {"nodes": nodes, "edges": edges}, str(tmp_path), "v1")
    now = store.current(spark, str(tmp_path))
    new = spark.createDataFrame([("c", "g")], "id string, filePath string")
    after = store.replace_files(now["nodes"], now["edges"], new, edges.limit(0), new.select("filePath"))
    store.publish(spark, dict(zip(("nodes", "edges"), after, strict=True)), str(tmp_path), "v2")
    got = store.current(spark, str(tmp_path))
    assert rows(got["nodes"].select("id", "filePath")) == [("a", "f"), ("c", "g")] and rows(got["edges"]) == []
    assert rows(store.without_orphans(nodes, edges)) == [("a", "b", "calls")]


def test_notes_merge(spark):
    notes = spark.createDataFrame([(1, "todo", "fix the login page soon", None, ["a"], ["x"]), (2, "todo", "fix the login page soon please", None, ["b"], []), (3, "gotcha", "fix the login page soon", 0.2, [], []), (4, "todo", "other thing", 0.9, [], [])], "id long, category string, content string, importance double, tags array<string>, files array<string>")
    got = {r.id: r for r in memory.created(notes, 0.8).collect()}
    assert set(got) == {1, 3, 4} and got[1].content.endswith("please") and got[1].merges == 1 and round(got[1].importance, 6) == 0.65 and set(got[1].tags) == {"a", "b"}
    df = spark.createDataFrame([(i, f"t{i}", "d") for i in range(40)], "id long, title string, description string")
    assert memory.checksum(df.repartition(3), ["id", "title"]).first() == memory.checksum(df, ["id", "title"]).first() != memory.checksum(df.limit(39), ["id", "title"]).first()
    with pytest.raises(ValueError):
        memory.taught(df, "nonsense", "x")


def test_two_notes_merge_and_tags_equal_their_sql(spark, tmp_path):
    import duckdb

    note = lambda n: {x: F.col(f"{x}{n}") for x in ("content", "tags", "files", "importance")}
    pairs = spark.createDataFrame([("abc", ["x", "y"], None, 0.4, "abd", ["y", "z"], ["f"], 0.9), ("ab", None, ["f"], 0.98, "abc", ["q"], ["f"], None), (None, [], [], 0.1, "a", ["q", "q"], [], 0.1)], ", ".join(f"content{n} string, tags{n} array<string>, files{n} array<string>, importance{n} double" for n in (1, 2)))
    got = pairs.select(*(c.alias(k) for k, c in memory.merged(note(1), note(2)).items())).collect()
    assert [(r.content, r.tags, r.files, round(r.importance, 6)) for r in got] == [("abc", ["x", "y", "z"], ["f"], 0.95), ("abc", ["q"], ["f"], 1.0), ("a", ["q"], [], 0.15)]
    odd = [(1, "en", "Src1"), (2, None, "b"), (3, None, None), (4, "", "A"), (5, "b", "b"), (6, "de", None), (None, "x,y", "Ba")]
    spark.createDataFrame([(i, "a text", *x) for i, *x in odd], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(ORACLES["u6_tag_union"].replace("documents", f"read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, text_queries.u6_tag_union(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


# --- graph and reports


def test_components_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    reach = {i: {i} for i in range(40)}
    for _ in range(40):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {(i, min(j for j in reach[i] if i in reach[j])) for i in range(40) if any(j != i and i in reach[j] for j in reach[i])}
    assert {tuple(r) for r in graph.strongly_connected(spark.createDataFrame(edges, "src int, dst int")).collect()} == want


def test_ranks_converge(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("a", "d", "imports")], "sourceId string, targetId string, type string")
    done, more = ({r.id: r.score for r in graph.pagerank(nodes, edges, eps=e).collect()} for e in (1e-6, 1e-9))
    assert done == pytest.approx(more, abs=1e-5) and sum(done.values()) == pytest.approx(1)


def test_repo_map_and_flow(spark):
    n = [("a", "function", "run", "m.run", "/x.py", 3, "def run()", "Runs it.\nMore.", "service"), ("b", "function", "save", "save", "/x.py", 1, "def save()", None, "database"), ("c", "function", "deep", "deep", "/y.py", 1, "def deep()" + "x" * 400, None, "util"), ("f", "file", "x.py", "/x.py", "/x.py", 1, "", None, "service")]
    nodes = spark.createDataFrame(n, "id string, type string, name string, qualifiedName string, filePath string, startLine int, signature string, docComment string, layer string")
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.2), ("c", 0.3)], "id string, score double")
    assert [r.line for r in report.repo_map(nodes, ranks, 60).orderBy("place").collect()] == ["\n// /x.py", "def save()", "  /** Runs it. */\n  def run()", "\n// /y.py"]
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "c", "uses"), ("b", "a", "calls"), ("a", "f", "contains")], "sourceId string, targetId string, type string")
    steps = flow.trace(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert [(r.step, r.id, r.action, r.produces) for r in steps.orderBy("step").collect()] == [(0, "a", "processes in run()", None), (1, "b", "queries database in save()", "DB result"), (2, "c", "uses helper deep()", None)]
    assert [(r.n_steps, r.risk) for r in flow.flow_summary(steps).collect()] == [(3, "high")]


def test_clones_do_not_overlap(spark):
    block = "\n".join(f"line {i}" for i in range(8))
    got = quality.clone_groups(spark.createDataFrame([(1, block + "\n" + block), (2, "same\n" * 30)], "doc int, text string"), 6).collect()
    assert max(r.places for r in got) == 5 and {r.places for r in got if r.docs == 1} <= {2, 5}


def test_hot_keys_fold_in_segments(spark):
    from tessera.operators import changes

    kinds = ["created", "modified", "deleted", "modified", "created"]
    events = [("hot", i, i, kinds[(i * i) % 5]) for i in range(3000)] + [("cold", 1, 1, "deleted"), ("cold", 2, 2, "created")]
    state = ""
    for e in events[:3000]:
        state = changes.followed(state, e[3])
    got = {r.k: r.state for r in changes.collapse(spark.createDataFrame(events, "k string, ts long, id long, kind string").repartition(7), ["k"]).collect()}
    assert got == {k: s for k, s in (("hot", state), ("cold", "modified")) if s}


def test_classes_of_equal_sets(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(5)] + [(9, ["a", "b", "c", "d"]), (10, ["z"])], "doc int, w array<string>")
    got = {r.doc: (r.n_links, r.class_id) for r in alike.similar_classes(docs, F.col("w"), 0.7).collect()}
    assert got == {**{i: (5, 0) for i in (0, 1, 2, 3, 4, 9)}, 10: (0, 10)}
