"""Importance resampling against plain Python, and its histogram by itself."""

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from llm_fixtures import ODD, docs, prose
from pyspark.sql import functions as F

from tessera.llm import importance_sampling as imp


def features(text, ngram=1):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=10, ngram=1, seed=2024):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in rows:
        np.add.at(s, features(text, ngram)[1], 1)
    for text in target:
        np.add.at(t, features(text, ngram)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for k, (i, text) in enumerate(rows):
        words, found = features(text, ngram)
        u = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5
        weight = sum(gain[b] for b in found)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log(u / 4294967296))), len(words) >= 20, k))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[5]: n + 1 for n, r in enumerate(order[: percent * len(order) // 100])}
    return sorted(str((*r[:4], rank.get(r[5]))) for r in out)


def resampled(spark, df, target, **more):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted(str(tuple(r)) for r in imp.resample(df, bench, **more).collect())


TARGET = ["alpha beta gamma delta", "Straße 12 omega", None, ""]


@pytest.mark.parametrize("more", [{}, {"percent": 35, "ngram": 2}, {"percent": 100, "seed": 7}])
def test_equals_plain_python(spark, more):
    rows = [(i, t) for i, t, *_ in ODD] + [(100 + i, prose(i, 5 + i % 60)) for i in range(200)]
    df = docs(spark, rows).repartition(5).withColumns({c: F.lit("clash") for c in ("row", "score", "words", "weight", "rank", "band", "ids")})
    assert resampled(spark, df, TARGET, **more) == brute(rows, TARGET, **more)


def test_nothing_to_draw(spark):
    assert resampled(spark, docs(spark, []), TARGET) == []
    assert all(r.endswith("None)") for r in resampled(spark, docs(spark, ODD[:3]), []))


def test_ranks_of_scores_that_many_share(spark):
    """Ties go to smaller ids, also over ranges of ids and with bands of many scores."""
    rng = random.Random(3)
    rows = [(i, rng.choice([-(10**9), 5, 5, 5, 6, 7, 10**9])) for i in rng.sample(range(-(10**8), 10**8), 900)] + [(None, 5), (3, 5), (3, 5)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row long, doc_id long, score long")
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for draw in (1, 450, len(rows)):
        got = {r.rank: (r.doc_id, r.score) for r in imp.ranked(df, draw).collect()}
        assert [got[k + 1] for k in range(draw)] == order[:draw] and len(got) == draw


def test_histogram_has_exact_suffix_sums(spark):
    rng = random.Random(5)
    scores = [int(rng.gauss(0, 3000)) for _ in range(4000)] + [10**12]
    got = imp.histogram(spark.createDataFrame([(s,) for s in scores], "score long")).collect()
    assert {(r.score, r.n, r.higher) for r in got} == {(s, scores.count(s), sum(x > s for x in scores)) for s in set(scores)}


def test_a_long_text_counts_whole(spark):
    text = "alpha " * 300_000 + "omega"
    assert resampled(spark, docs(spark, [(1, text), (2, prose(1, 30))]), TARGET, percent=50) == brute([(1, text), (2, prose(1, 30))], TARGET, percent=50)
