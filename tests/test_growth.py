"""Steps that large graphs go through once: their plans and their results on small ones with repeats and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as t
from tessera.operators import compress, flow, graph, report

EDGES = "sourceId string, targetId string, type string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orphans_ask_for_both_ends_in_one_pass(spark):
    rows = [("a", "b", "calls"), ("a", "b", "calls"), ("a", "x", "uses"), ("x", "b", "uses"), ("x", "y", "uses"), ("x", "y", "uses"), (None, "a", "calls"), ("a", None, "calls")]
    edges = spark.createDataFrame(rows, EDGES).repartition(3)
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    found = graph.orphan_edges(nodes, edges)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, set(rows) - {("a", "b", "calls")}))
    assert plan_of(found).count("RepartitionByExpression") + plan_of(found).count("Repartition 3") == 1  # edges are read once


def test_edges_of_the_tables_drop_repeats_once(spark):
    edges, repeated = (t.edges(spark, "/root/testdata/sf0.001", repeats=x) for x in (False, True))
    assert edges.exceptAll(repeated.distinct()).isEmpty() and repeated.distinct().exceptAll(edges).isEmpty()
    assert "Aggregate" not in plan_of(repeated) and plan_of(edges).count("Aggregate") == 1


def test_walks_and_flows_take_repeated_edges(spark):
    rows = [("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "uses"), ("c", "f", "uses"), ("c", "g", "calls"), ("c", "gone", "calls"), ("g", "a", "uses"), ("b", "d", "uses")]
    nodes = spark.createDataFrame([(x, {"f": "file", "g": "file"}.get(x, "function"), x, "/x", "util") for x in "abcdfg"], "id string, type string, name string, filePath string, layer string")
    seeds = spark.createDataFrame([("a",), ("c",)], "id string")
    want = None
    for times, few in ((1, flow.MOST_BROADCAST), (3, flow.MOST_BROADCAST), (3, 0)):
        edges = spark.createDataFrame(rows * times, EDGES)
        before, flow.MOST_BROADCAST = flow.MOST_BROADCAST, few
        try:
            steps = sorted(tuple(r) for r in flow.trace(nodes, edges, seeds).select("seed", "depth", "step", "id").collect())
        finally:
            flow.MOST_BROADCAST = before
        layers = sorted(tuple(r) for r in graph.layered_impact(edges, spark.createDataFrame([("c",)], "id string")).collect())
        want = want or (steps, layers)
        assert (steps, layers) == want
    assert [r[1:] for r in want[0] if r[0] == "a"] == [(0, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 3, "d"), (2, 4, "g")]  # g is a file that is called, f one that isn't
    assert [r[1:] for r in want[0] if r[0] == "c"] == [(0, 0, "c"), (1, 1, "g"), (2, 2, "a"), (3, 3, "b"), (4, 4, "d")]
    assert want[1] == [("c", 1, 2), ("c", 2, 1)]


def test_a_trace_makes_its_moves_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        reads.add(1)
        yield from batches

    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")], EDGES).coalesce(1).mapInArrow(seen, EDGES)
    nodes = spark.createDataFrame([(x, "function", x, "/x", "util") for x in "abcd"], "id string, type string, name string, filePath string, layer string")
    assert flow.trace(nodes, edges, nodes.where(F.col("id") == "a").select("id")).count() == 4
    assert reads.value == 1


def test_a_map_of_many_symbols_sends_few_to_one_task(spark):
    """Of 20,000 symbols in 7 files those that the budget can hold go on; the map is what a walk through all of them gives."""
    sizes = (3, 9, 40, 41, 200, 0, 5000)
    rows = [(f"s{i:05}", "function", f"f{i}", "q", f"/f{i * 7919 % 7}", i * 31 % 1009, None if i % 4001 == 7 else chr(97 + i % 26) * sizes[i * i % 7]) for i in range(20_000)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, qualifiedName string, filePath string, startLine int, signature string").repartition(8)
    ranks = spark.createDataFrame([(r[0], float(int(r[0][1:]) % 5003)) for r in rows], "id string, score double")
    top = {}
    for r in rows:
        top[r[4]] = max(top.get(r[4], 0.0), float(int(r[0][1:]) % 5003))
    for budget in (2, 40, 701):
        used, file, want = 0, None, []
        for r in sorted(rows, key=lambda r: (-top[r[4]], r[4], r[5], r[0])):
            if r[4] != file:
                file, head = r[4], f"\n// {r[4]}"
                if used + -(-len(head) // 4) > budget:
                    break
                used += -(-len(head) // 4)
                want.append(head)
            if used + -(-len(r[6] or "") // 4) <= budget:
                used += -(-len(r[6] or "") // 4)
                want.append(r[6] or "")
        out = report.repo_map(nodes, ranks, budget)
        assert [r.line for r in out.orderBy("place").collect()] == want
        assert plan_of(out).count("row_number") >= 3


def test_lengths_of_forms_are_those_of_their_texts(spark):
    texts = [("diff", "diff --git a b\n x\n+y\n z\n w\n v\n-q"), ("plain_text", "One. Two.\n\né\U0001f600 three. Four."), ("json_data", '{"a": [1, 2, 3, 4]}'), ("plain_text", ""), ("plain_text", None), ("nothing", " \n ")]
    d = spark.createDataFrame(texts, "kind string, text string")
    levels = ("minimal", "moderate", "aggressive")
    whole = [F.length(compress.compress(F.col("text"), F.col("kind"), x)).cast("long").alias(x) for x in levels]
    assert d.select(compress.lengths(F.col("text"), F.col("kind"), levels).alias("n")).select("n.*").collect() == d.select(*whole).collect()


def test_measured_texts_of_one_file_are_many_tasks(spark):
    """a file of one row group is read by one task, so texts are dealt anew before their lines are looked at."""
    from tessera.plans import report_queries

    name = "spark.sql.adaptive.coalescePartitions.enabled"  # these tables are small enough to be put together again
    spark.conf.set(name, "false")
    try:
        texts = report_queries._metric_texts(spark, "/root/testdata/sf0.001").where("doc LIKE 'd%'")
        assert texts.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset(name)


def test_lines_without_what_is_counted_add_nothing(spark):
    from tessera.operators import quality

    code = "plain words\n  // if (x) {\nif (a && b) {\n  nothing here\n  x = a ?? b || c ? d : e\n  } catch (e) {\n\n}\nandroid for_each doc\n* while\ndo (x)"
    lines = spark.createDataFrame([(x,) for x in code.split("\n")], "line string")
    m = lines.select("line", quality.line_metrics(F.col("line")).alias("m")).where(~F.col("line").rlike(quality.COUNTED)).select("m.*").collect()
    assert len(m) == 4 and {tuple(r) for r in m} == {(0, 0, 0, 0, 0)}
    assert quality.complexity(spark.createDataFrame([(1, code)], "doc int, text string")).first().loc == 11


def test_components_move_numbers(spark, monkeypatch):
    """names of nodes are read at the start and at the end only."""
    m = [(a, b) for k in range(4) for a, b in ((f"a{k}", f"b{k}"), (f"b{k}", f"c{k}"), (f"c{k}", f"a{k}"), (f"c{k}", f"d{k}"), (f"d{k}", f"e{k}"), (f"a{k}", f"a{k}"), (f"e{k}", "a0"), ("e0", f"c{k}"))]
    kinds, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: kinds.append(dict(df.dtypes)) or real(df))
    rows = [*m, *m, ("x", "a1"), ("x", "y"), ("y", "z"), ("z", "y"), (None, "a0"), ("a0", None)]
    found = {tuple(r) for r in graph.strongly_connected(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert found == {(f"{x}{k}", "a0") for k in range(4) for x in "abcde"} | {("y", "y"), ("z", "y")}
    assert len(kinds) > 3 and all("string" not in k.values() for k in kinds[2:])
