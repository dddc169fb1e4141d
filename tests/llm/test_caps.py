"""Spherical-cap filters: equal to brute force where vectors are alike, and their recall at the limit."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import spherical_filters as sf

FLOATS = "vec_id long, embedding array<float>"


def brute(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) of each row."""
    fit = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[i][1]) for i in fit), default=1)
    x = np.array([[*rows[i][1], *[0.0] * (width - len(rows[i][1]))] for i in fit]).reshape(len(fit), width)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    root = sf._roots(len(fit), a, b)
    low = {r: min(rows[fit[k]][0] for k in np.flatnonzero(root == r)) for r in set(root.tolist())}
    known = {fit[k]: (int(hit[k].sum()), low[root[k]]) for k in range(len(fit))}
    return sorted(str((i, *known.get(k, (0, i)), i is None or known.get(k, (0, i))[1] == i)) for k, (i, _) in enumerate(rows))


def found(df, **options):
    return sorted(str(tuple(r)) for r in sf.near_vectors(df, **options).collect())


def near(rng, v, cos, n):
    """n vectors at that cosine to v."""
    w = rng.normal(size=(n, len(v)))
    w -= (w @ v)[:, None] * v
    return cos * v + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w, axis=1, keepdims=True)


def rows_of(rng, width=64):
    x = rng.normal(size=(120, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups = [near(rng, x[0], 0.97, 60), near(rng, x[1], 0.93, 20), near(rng, x[2], 0.85, 10), np.repeat(x[3:4], 30, 0), x[4:6] * 7]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(np.concatenate([x, *groups]))]


def test_equals_brute_force(spark):
    """Copies, near copies and scaled copies; with one block a filter, and with several."""
    rows = rows_of(np.random.default_rng(2))
    df = spark.createDataFrame(rows, FLOATS).repartition(5)
    for block in (1024, 7):
        assert found(df, block=block) == brute(rows)


def test_awkward_vectors(spark):
    odd = [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1004, [None] + [1.0] * 63), (1005, [float("inf")] * 64), (None, [1.0] * 64), (1006, [1.0]), (1007, [2.0, 0.0]), (1008, [1.0] + [1e-30] * 70), (1009, [1e-40, 0.0]), (3, [-1.0]), (3, [-1.0])]
    rows = rows_of(np.random.default_rng(4))[:40] + odd
    rows = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    df = spark.createDataFrame(rows, FLOATS).withColumns({c: F.lit("clash") for c in ("node", "weight", "k1", "label", "links", "filter", "own", "i")})
    assert found(df) == brute(rows)
    assert found(spark.createDataFrame([], FLOATS)) == []
    assert found(spark.createDataFrame([(1, None), (2, None)], FLOATS)) == ["(1, 0, 1, True)", "(2, 0, 2, True)"]


def test_narrow_and_wide_vectors(spark):
    rng = np.random.default_rng(8)
    for width in (3, 200):
        rows = rows_of(rng, width)
        df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
        assert found(df) == brute(rows)


def test_recall_at_the_limit():
    """Pairs at a cosine of just 0.9, where it is lowest; random pairs seldom meet."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.concatenate([near(rng, v, 0.9, 1) for v in x])
    codes = sf.product_codes(64)
    a, b = sf.decoded(x, codes), sf.decoded(y, codes)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) > 0.995
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, a[1:], strict=False)]) < 0.02
    assert min(map(len, a)) >= sf.FEWEST and np.mean([len(p) for p in a]) < 60


def test_list_decoding_finds_every_filter():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = sf.product_codes(64, 3, 40)
    for k, got in enumerate(sf.decoded(x, codes, 2.5, 0)):
        want = []
        for c, (signs, first, second) in enumerate(codes):
            y = x[k : k + 1]
            for s in signs:
                y = sf.hadamard(y * s)
            assert np.isclose(np.linalg.norm(y), 1)
            cos = (y[:, :32] @ first)[0][:, None] + (y[:, 32:] @ second)[0]
            want += (np.flatnonzero(cos.ravel() >= 2.5 / 8) + c * 1600).tolist()
        assert got.tolist() == want
