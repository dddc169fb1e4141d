import random
import zlib

import numpy as np
from llm_fixtures import ODD, docs, prose
from pyspark.sql import functions as F

from tessera.llm import quality_classifier as qc
from tessera.llm import topk_search


def brute_top(rows, k=5):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max((len(v) for _, v in good), default=0)
    z = [(i, [int(np.floor(256 * float(x))) for x in v] + [0] * (width - len(v))) for i, v in good]
    out = set()
    for q in {i for i, _ in z if i % 50 == 0}:
        scores = {(-sum(a * b for a, b in zip(x, y, strict=True)), i) for j, x in z if j == q for i, y in z if i != q}
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 12)]) for i in range(300)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(40)] + [(700, None), (750, [float("nan")] * 12), (800, [float("inf")] + [0.0] * 11), (850, [None] + [0.0] * 11), (900, [0.5] * 3), (950, []), (None, [1.0] * 12), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rb", F.lit("clash"))
    for block, asked in ((2048, 1024), (37, 3)):
        got = topk_search.top_k(df, F.col("vec_id") % 50 == 0, row_block=block, query_block=asked).collect()
        assert {tuple(r) for r in got} == brute_top(rows) and len(got) == len(brute_top(rows))
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_search_stops_early_and_only_on_proof():
    rng = np.random.default_rng(0)
    rows, asks = rng.integers(-3, 4, (500, 16)), rng.integers(-3, 4, (20, 16))
    for i in range(20):
        rows[i, rng.integers(0, 16)] = 3000
    for step in (1, 7, 16, 500):
        q, r, s, used = topk_search.search_block(np.arange(500), rows, np.arange(1000, 1020), asks, 5, step)
        full = asks @ rows.T
        for i in range(20):
            best = set(np.argsort(-full[i], kind="stable")[:5])
            assert min(full[i][list(best)]) >= np.sort(full[i])[-5]
            assert set(np.flatnonzero(full[i] >= np.sort(full[i])[-5])) <= set(r[q == i])
        assert (s == full[q, r]).all()
    assert topk_search.search_block(np.arange(500), rows, np.arange(1000, 1020), asks, 5, 1, few=500)[3] < len(np.unique(np.abs(rows)))


def test_classifier_on_rows_it_has_not_seen(spark):
    rng = random.Random(6)
    rows, marks = [(i, t) for i, t, *_ in ODD], []
    for i in range(20, 420):
        good = i % 4 != 0
        text = prose(i, 60)
        rows.append((i, text if good else rng.choice([text.upper(), " ".join(w + "###" for w in text.split()), (text[:30] + " ") * 20])))
        marks.append((i, int(good), 0))
    labels = spark.createDataFrame([*marks, (20, None, 0), (None, 1, 0), (7, 5, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    model = qc.fit(df, labels, max_fit=200)
    got = {r.doc_id: r for r in qc.score(df, model).collect()}
    truth = {i: y for i, y, _ in marks}
    assert all(r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    unseen = [(truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth]
    assert sum(a == b for a, b in unseen) / len(unseen) > 0.95
    again = qc.fit(df.repartition(7), labels.repartition(3), max_fit=200)
    assert np.array_equal(again.weights, model.weights) and again.slope == model.slope


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, ODD)
    assert {r.score for r in qc.score(df, qc.fit(df, none)).collect()} == {0.5}
    assert qc.score(docs(spark, []), qc.fit(docs(spark, []), none)).collect() == []


def test_dual_coordinate_descent_separates():
    rows = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])]
    values = [np.ones(len(r)) for r in rows]
    y = np.array([1.0, -1.0, 1.0, -1.0])
    w, b = qc.dual_coordinate_descent(rows, values, y, 3, np.full(4, 10.0))
    assert all(y[i] * (w[rows[i]].sum() + b) >= 0.99 for i in range(4))


def test_repeated_rows_leave_no_place_unfilled():
    rng = np.random.default_rng(5)
    rows, ask = rng.integers(-300, 300, (60, 12)), rng.integers(-300, 300, (1, 12))
    best = np.argsort(-(ask @ rows.T)[0], kind="stable")
    for copies in (2, 6):
        ids = np.concatenate([np.arange(60), np.full(copies - 1, best[0])])
        full = np.concatenate([rows, np.repeat(rows[best[:1]], copies - 1, axis=0)])
        q, r, s, _ = topk_search.search_block(ids, full, np.array([1000]), ask, 5, few=0)
        keep = topk_search._best(q, ids[r], s, 5)
        assert ids[r[keep]].tolist() == best[:5].tolist()


def test_a_reached_score_ends_a_block_early():
    """With what the whole index reaches, a block without members is left after a small share of its postings."""
    rng = np.random.default_rng(2)
    rows, asks = rng.integers(-40, 41, (400, 16)), rng.integers(-40, 41, (8, 16))
    rows[:60] *= 8
    full = asks @ rows.T
    best = np.sort(full, axis=1)[:, -5]
    q, r, s, used = topk_search.search_block(np.arange(60, 400), rows[60:], np.arange(1000, 1008), asks, 5, 4, few=0, reached=best)
    want = {(i, j) for i in range(8) for j in range(340) if full[i, 60 + j] >= best[i]}
    assert want <= set(zip(q.tolist(), r.tolist(), strict=True)) and used < len(np.unique(np.abs(rows[60:]) // 4))
    order, levels, ends = topk_search.ordered(rows, 4)
    assert ends[-1] == rows.size and (np.diff(levels) < 0).all() and (np.diff(np.abs(rows.ravel()[order]) // 4) <= 0).all()
