"""The Merkle manifest against one that plain Python builds."""

import zlib
from hashlib import sha256

import pytest
from llm_fixtures import ODD, docs, prose
from pyspark.sql import functions as F

from tessera.llm import merkle_manifest as mm


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def layers(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    for nodes in tree[:-1]:
        run, k = nodes[i // 8 * 8 :][:8], i % 8
        yield run[:k], run[k + 1 :]
        i //= 8


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars)."""

    def leaf(r, text):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text))

    by_lang = {}
    for r in rows:
        lower = r[1] and r[1].translate({c: c + 32 for c in range(65, 91)})
        own = leaf(r, r[1])
        tampered = leaf(r, lower) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, own, tampered, r[0]))
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: layers([r[2] for r in sorted(by_lang[x])]) for x in names}
    top = layers([trees[x][-1][0] for x in names]) if names else []
    out = []
    for k, x in enumerate(names):
        for i, (_, _, own, node, doc_id) in enumerate(sorted(by_lang[x])):
            steps = [*path(trees[x], i), *path(top, k)]
            for left, right in steps:
                node = h([*left, node, *right])
            out.append((doc_id, own, trees[x][-1][0], top[-1][0], h(s for a, b in steps for s in a + b), node, node == top[-1][0]))
    return sorted(map(str, out))


def proved(df, **sizes):
    tampered, where = mm.tampering()
    return sorted(str(tuple(r)) for r in mm.prove(mm.leaves(df, tampered=tampered, where=where), **sizes).collect())


ROWS = [(i, prose(i, 8).title() if i % 2 else prose(i, 8), ("en", "en", "en", None, "", "ñ", "z")[i % 7], f"src{i % 3}", i) for i in range(400)]


@pytest.mark.parametrize("sizes", [{}, {"levels": 1, "top": 40}, {"levels": 2, "top": 3}])
def test_equals_plain_python(spark, sizes):
    """In one round, in several, and with more groups than the driver may have."""
    got = proved(docs(spark, ROWS).repartition(7), **sizes)
    assert got == brute(ROWS) and len(got) == 400
    assert {"True", "False"} == {r.rsplit(" ", 1)[1][:-1] for r in got}


def test_awkward_rows(spark):
    rows = [(*r[:2], *((r[2:] or ("en", "s", None)))) for r in ODD] + [(None, None, None, None, None)] * 2 + [(12, "LONG " * 60_000, "x", None, -1)]
    df = docs(spark, rows).withColumns({c: F.lit("clash") for c in ("tree", "pos", "n", "digest", "block", "path", "at", "leaf", "changed")})
    assert proved(df) == brute(rows)
    assert proved(docs(spark, rows[:1])) == brute(rows[:1])  # a lone leaf is the root
    assert proved(docs(spark, [])) == []


def test_a_proof_shows_what_was_changed(spark):
    df = docs(spark, ROWS)
    where = F.col("doc_id") == 5
    got = mm.prove(mm.leaves(df, tampered={"source": F.lit("other")}, where=where)).collect()
    assert [r.doc_id for r in got if not r.verified] == [5]
    assert all(r.verified for r in mm.prove(mm.leaves(df)).collect())


def test_many_groups(spark):
    rows = [(i, "t", f"g{i % 97}", "s", 1) for i in range(300)]
    assert proved(docs(spark, rows), levels=1, top=5) == brute(rows)
