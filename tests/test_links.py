"""Alike notes and decisions, innermost intervals, shortest paths and cycles, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import alike, graph, intervals, memory, paths, text
from tessera.operators.text import words


def share(p, q):
    p, q = set(p), set(q)
    return len(p & q) / len(p | q) if p | q else 0.0


def classes(ids, links):
    """(id, n_links, class_id) by links (a, b)."""
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return sorted((i, sum(i in x for x in links), root[i]) for i in ids)


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.45, 0.55, 0.8, 1.0])
def test_conflicts_equal_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    tags = [[], ["p"], ["P"], ["q"], ["p", "q"], ["p", "q", "r"], ["r", "s", "t", "u"], ["r", "s", "t"], ["x1"], None, ["p", "q", "r", "s"]]
    dec = [(i, "active" if i % 9 else "reversed", " ".join(rng.sample("abcdefgh", rng.randrange(0, 4))), " ".join(rng.sample("uvwx", rng.randrange(0, 3))), rng.choice(tags)) for i in range(90)]
    dec += [(100 + i, "active", "a b", "u", ["p"]) for i in range(5)] + [(200, "active", None, None, None), (201, "active", "", "", [])]
    low = lambda x: {t.lower() for t in x or []}
    text = lambda d: f"{d[2] or ''} {d[3] or ''}".split()
    live = [d for d in dec if d[1] == "active"]
    links = [(a[0], b[0]) for a, b in itertools.combinations(live, 2) if 0.6 * share(text(a), text(b)) + 0.4 * share(low(a[4]), low(b[4])) >= threshold]
    df = spark.createDataFrame(dec, "id long, status string, title string, description string, tags array<string>").repartition(3)
    assert sorted(tuple(r) for r in alike.conflict_classes(df, threshold).collect()) == classes([d[0] for d in live], links)


def test_conflicts_of_nothing(spark):
    none = spark.createDataFrame([], "id long, status string, title string, description string, tags array<string>")
    assert alike.conflict_classes(none).collect() == []


def test_duplicates_equal_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.sample("abcdefghijklmnop", 8) for _ in range(12)]
    notes = [(i, " ".join(w for w in rng.choice(base) if rng.random() < 0.93), rng.choice(["x", "y", None])) for i in range(120)] + [(500, None, "x"), (501, "", "x"), (502, "...", None)]
    df = spark.createDataFrame(notes, "id long, content string, category string")
    links = [(a[0], b[0]) for a, b in itertools.combinations(notes, 2) if a[2] == b[2] and share((a[1] or "").strip(".").split(), (b[1] or "").strip(".").split()) >= 0.8]
    assert sorted(tuple(r) for r in memory.duplicates(df, 0.8).collect()) == classes([n[0] for n in notes], links)
    assert {r.doc for r in alike.similar_classes(df.select(F.col("id").alias("doc"), "content"), words(F.col("content")), 0.8).collect()} == {n[0] for n in notes}


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_innermost_equals_every_pair(spark, block):
    rng = random.Random(block)
    spans = [(rng.choice("ab"), f"s{i}", a, a + rng.choice([0, 1, 5, 30, 200, -1])) for i in range(150) for a in [rng.randrange(1, 150)]]
    points = [(rng.choice("abc"), rng.randrange(1, 200)) for _ in range(300)]
    got = intervals.innermost(spark.createDataFrame(spans, "path string, id string, startLine int, endLine int"), spark.createDataFrame(points, "path string, line_no int"), block)
    want = []
    for path, line in set(points):
        inside = [(z - a, i) for p, i, a, z in spans if p == path and a <= line <= z]
        want += [(path, line, min(inside)[1])] if inside else []
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_a_file_of_a_million_lines(spark):
    """One hot file: its lines are many tasks, and each is swept once."""
    points = spark.range(1, 1_000_001).select(F.lit("hot").alias("path"), F.col("id").cast("int").alias("line_no"))
    spans = spark.range(0, 100_000).select(F.lit("hot").alias("path"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), (F.col("id") * 10 + 1).cast("int").alias("startLine"), (F.col("id") * 10 + 5).cast("int").alias("endLine"))
    whole = spark.createDataFrame([("hot", "whole", 1, 1_000_000)], "path string, id string, startLine int, endLine int")
    got = intervals.innermost(spans.unionAll(whole), points)
    assert got.groupBy((F.col("id") == "whole").alias("w")).count().orderBy("w").collect() == [(False, 500_000), (True, 500_000)]


def test_lines_are_read_within_limits(spark):
    lines = spark.range(1, 900).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line_no"), F.lit("x").alias("line"))
    none = spark.createDataFrame([], "path string, id string, startLine int, endLine int")
    assert [intervals.read_lines(lines, none, *a).count() for a in ((), (5, 10), (1, 10_000), (890, 500), (1, -3))] == [200, 10, 500, 10, 0]


def random_graph(rng, n, m):
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)})


def shortest(moves, a, b, most):
    front = [(a,)]
    for _ in range(most + 1):
        hit = [p for p in front if p[-1] == b]
        if hit:
            return min(hit)
        best = {}
        for p in front:
            for x, y in moves:
                if x == p[-1] and y not in p:
                    best[y] = min(best.get(y, (*p, y)), (*p, y))
        front = list(best.values())
    return None


@pytest.mark.parametrize("most", [1, 2, 5, 10])
def test_shortest_paths_themselves(spark, most):
    rng = random.Random(most)
    moves = random_graph(rng, 30, 60)
    names = sorted({x for m in moves for x in m})
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [("n00", "zz"), ("zz", "zz")]
    got = paths.shortest_paths(spark.createDataFrame(moves, "src string, dst string"), spark.createDataFrame(pairs, "a string, b string"), most)
    want = {(a, b): p for a, b in set(pairs) if (p := shortest(moves, a, b, most))}
    assert {(r.a, r.b): tuple(r.path) for r in got.collect()} == want
    assert all(r.length == len(r.path) - 1 for r in got.collect())


def test_cycles_equal_all_simple_ones(spark):
    rng = random.Random(8)
    moves = random_graph(rng, 14, 30)
    m = spark.createDataFrame(moves, "src string, dst string")
    found: dict = {}

    def walk(path, most):
        for x, y in moves:
            if x == path[-1] and y == path[0] and len(path) > 1:
                found.setdefault(path[0], []).append((len(path), path))
            elif x == path[-1] and y > path[0] and y not in path and len(path) < most:
                walk((*path, y), most)

    for most in (2, 3, 6):
        found.clear()
        for n in sorted({x for e in moves for x in e}):
            walk((n,), most)
        best = {n: min(c) for n, c in found.items()}
        want = {}
        for n, c in best.values():
            key = tuple(sorted(c))
            want[key] = min(want.get(key, c), c)
        for members in (None, graph.strongly_connected(m)):
            assert sorted(tuple(r.cycle) for r in paths.cycles(m, most, members).collect()) == sorted(want.values())


def test_pairs_that_cannot_be_similar_are_not_sent_on(spark, monkeypatch):
    """Sets that share their rarest words and nothing else are dropped where they meet; similar ones all stay."""
    rng = random.Random(5)
    sets = [(i, [f"g{i // 20}_{k}" for k in range(5)] + rng.sample([f"w{k}" for k in range(400)], 95)) for i in range(200)]
    sets += [(1000 + i, w[: 100 - i % 15] + [f"x{i}_{k}" for k in range(i % 5)]) for i, (_, w) in enumerate(sets[:60])]
    want = {(a, b): len(set(v) & set(w)) / len(set(v) | set(w)) for a, v in sets for b, w in sets if a < b}
    want = {k: x for k, x in want.items() if x >= 0.8}
    sent, confirmed = [], text._confirmed
    monkeypatch.setattr(text, "_confirmed", lambda pairs, *rest: (sent.append(pairs.count()), confirmed(pairs, *rest))[1])
    got = {(r.a, r.b): r.similarity for r in text.prefix_pairs(spark.createDataFrame(sets, "doc long, w array<string>"), 0.8).collect()}
    assert got == want and len(want) >= 50 and sent[0] <= 2 * len(want)
