import hashlib
import random
from collections import defaultdict

import pytest
from llm_fixtures import ODD, docs, prose
from pyspark.sql import functions as F

from tessera.llm import mixing

LEVELS = lambda: [mixing.domain_of(F.col("source")), F.col("lang"), F.col("source")]
WEIGHTS = [{"domain0": 4, "domain1": 3, "domain3": 0}, {"en": 3}, {}]


def water(children, total):
    """children: {key: (weight, cap)}; equal to the operator's rule, by repeated filling."""
    out, open_, left = {}, dict(children), total
    while True:
        w = sum(x for x, _ in open_.values())
        full = [k for k, (x, cap) in open_.items() if x and cap * w <= left * x]
        if not full:
            break
        least = min(full, key=lambda k: (open_[k][1] / open_[k][0] if open_[k][0] else float("inf"), k))
        out[least] = open_[least][1]
        left -= open_.pop(least)[1]
    w = sum(x for x, _ in open_.values())
    return out | {k: min(cap, left * x // w if w else 0) for k, (x, cap) in open_.items()}


def by_brute_force(rows, part, epochs, seed):
    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        digits = source[len(source.rstrip("0123456789")) :] if source else ""
        leaves[(f"domain{int(digits or 0) % 4}", lang, source)].append((i, len((text or "").split())))
    supply = {k: sum(t for _, t in v) for k, v in leaves.items()}
    total = sum(supply.values()) * part[0] // part[1]

    def down(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        keys = {k[: len(prefix) + 1] for k in supply if k[: len(prefix)] == prefix}
        kids = {k: (WEIGHTS[len(prefix)].get(k[-1], 1), sum(epochs * s for x, s in supply.items() if x[: len(k)] == k)) for k in keys}
        out = {}
        for k, b in water(kids, budget).items():
            out |= down(k, b)
        return out

    got = []
    for leaf, budget in down((), total).items():
        whole = budget // supply[leaf] if supply[leaf] else 1
        room = budget - whole * supply[leaf]
        got += [(i, e) for i, _ in leaves[leaf] for e in range(whole)]
        at = defaultdict(list)
        for i, t in leaves[leaf]:
            at[hashlib.md5(f"{seed}:{whole}:{'null' if i is None else i}".encode()).hexdigest()].append((i, t))
        for _, same in sorted(at.items()) if room > 0 else ():
            room -= sum(t for _, t in same)
            if room < 0:
                break
            got += [(i, whole) for i, _ in same]
    return sorted(got, key=str)


@pytest.mark.parametrize("part,epochs,few", [((3, 5), 2, 200), ((1, 4), 1, 2), ((5, 1), 3, 200), ((9, 10), 1, 5)])
def test_mix_equals_brute_force(spark, part, epochs, few):
    rng = random.Random(3)
    rows = [(i, t, lang, src) for (i, t, *_), lang, src in zip(ODD, ["en", None, "de"] * 9, ["src1", "src2", None, "web"] * 9, strict=False)]
    rows += [(100 + k, prose(k, rng.randrange(1, 60)), rng.choice(["en", "en", "de"]), rng.choice(["src0", "src0", "src5", "src6", "src3", "src4"])) for k in range(400)]
    df = docs(spark, [(i, t, lang, src, 0) for i, t, lang, src in rows]).withColumn("leaf", F.lit("clash"))
    got = mixing.mix(df, LEVELS(), WEIGHTS, part, epochs, 11, few).collect()
    assert sorted(((r.doc_id, r.epoch) for r in got), key=str) == by_brute_force(rows, part, epochs, 11)


def test_mix_documents_keeps_columns(spark):
    df = docs(spark, ODD).withColumn("epoch", F.lit("clash"))
    got = mixing.mix_documents(df, LEVELS(), WEIGHTS, (1, 1), 1)
    assert got.columns == df.columns and got.count() <= df.count()
    assert mixing.mix(docs(spark, []), LEVELS(), WEIGHTS).collect() == []
