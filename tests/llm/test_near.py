import random
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import ODD, docs, prose
from pyspark.sql import functions as F

from tessera.llm import graph, near_dedup


def by_brute_force(rows, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block,volume", [(100, 200_000), (7, 700)])
def test_components_equal_brute_force(spark, block, volume):
    rng = random.Random(4)
    rows = [(i, t) for i, t, *_ in ODD]
    for g in range(6):
        base = prose(g, 60 + 30 * g)
        rows += [(1000 * g + 100 + k, edited(rng, base, rng.randrange(0, 6))) for k in range(25)]
    rows += [(20_000 + k, prose(900 + k, 30)) for k in range(40)] + [(30_000, rows[-1][1]), (30_001, rows[-1][1].upper())]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(docs(spark, rows), block=block, block_shingles=volume).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == by_brute_force(rows)


def test_keep_one_and_empty(spark):
    df = docs(spark, [(1, prose(1, 30)), (2, prose(1, 30)), (3, None), (4, None), (None, prose(1, 30))]).withColumns({c: F.lit("clash") for c in ("digest", "_gone", "gone")})
    got = near_dedup.keep_one(df)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "None"]
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []


def test_estimate_is_close_to_the_truth():
    rng = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.85, 1.0):
        found = []
        for _ in range(40):
            z = rng.integers(0, 2**63, 600).astype(np.uint64)
            n = round(600 * 2 * j / (1 + j)) if j < 1 else 600
            a, b = z[:600], np.concatenate([z[:n], rng.integers(0, 2**63, 600 - n).astype(np.uint64)])
            x, y = (np.frombuffer(near_dedup.packed_bits(near_dedup.minima(s)), np.uint64) for s in (a, b))
            found.append(float(near_dedup.estimates(x, y[None])[0]))
        assert abs(np.mean(found) - j) < 0.03


def test_contraction_finds_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 600)]
    parent = defaultdict(lambda: None)
    for a, b in edges:
        parent[a], parent[b] = a, b
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            if parent[a] != m or parent[b] != m:
                parent[a] = parent[b] = m
                changed = True
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in parent.items() if k not in loops}


def test_a_large_bucket_in_blocks_has_the_same_components(spark):
    """Candidates of a bucket that is compared in pairs of blocks fall into the same components as in one block."""
    from tessera.llm.graph import components

    base = prose(3, 90).split()
    rng = random.Random(9)
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(50 + i, 60)) for i in range(30)]
    nodes = near_dedup.sketches(docs(spark, rows)).where("n_shingles > 0").dropDuplicates(["digest"])
    found = []
    for bucket in (1024, 40, 7):
        label = components(near_dedup.candidate_edges(nodes, bucket=bucket)).collect()
        found.append(sorted((bytes(r.node), bytes(r.label)) for r in label))
    assert found[0] and found[0] == found[1] == found[2]
