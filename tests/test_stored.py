"""Stored search structures against full scans."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, stored, text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["Straße", "ΣΑΣ", "naïve", "K2", "x" * 50]
    data = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.choice([0, 1, 3, 20, 200]))), rng.choice(["a b", "w3", ""])) for i in range(500)]
    data += [(1000, None, None), (1001, "", "w1"), (1002, "line one\nTHE w7 Line\n\nlast w7", "w7")]
    return spark.createDataFrame(data, "doc long, text string, title string").repartition(4)


@pytest.fixture(scope="module")
def blocks(spark, docs, tmp_path_factory):
    fields = {"text": text.words(F.col("text")), "title": text.words(F.col("title"))}
    return stored.blocks_of(spark, docs, fields, str(tmp_path_factory.mktemp("b")), shard=20), search.index(docs, fields)


@pytest.mark.parametrize("terms", [["w1"], ["w3", "w39"], ["w0", "w7", "w20"], ["w1", "none"], []])
@pytest.mark.parametrize("mode", ["all", "any"])
def test_scores_equal_the_plain_index(blocks, terms, mode):
    weights = {"text": 1.0, "title": 4.0}
    want = {r.doc: r.score for r in search.ranked(blocks[1], terms, weights, mode).collect()}
    got = {r.doc: r.score for r in stored.scored(blocks[0], terms, weights, mode).collect()}
    assert got == pytest.approx(want)
    for k in (1, 7, 1000):
        best = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        top = stored.top_k(blocks[0], terms, k, weights, mode).collect()
        assert sorted(((r.doc, round(r.score, 9)) for r in top), key=lambda x: (-x[1], x[0])) == [(d, round(s, 9)) for d, s in best]


def test_okapi_from_blocks(docs, blocks, spark, tmp_path):
    one = stored.blocks_of(spark, docs, {"text": text.words(F.col("text"))}, str(tmp_path), shard=20)
    want = {r.doc: r.score for r in text.okapi(docs, text.words(F.col("text")), ["w1", "w30"], threshold=float("-inf")).collect()}
    assert {r.doc: r.score for r in stored.scored(one, ["w1", "w30"], mode="any", idf="okapi").collect()} == pytest.approx(want)


def test_search_ends_on_proof(blocks):
    """The best of a word is found without most of its shards."""
    seen = []
    stored.top_k(blocks[0], ["w1"], 3, seen=seen)
    shards = blocks[0].blocks.where("term = 'w1'").count()
    assert 0 < sum(seen) < shards / 2


def test_filters_reach_the_files(blocks, docs, spark, tmp_path):
    plan = stored.scored(blocks[0], ["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w1)" in plan or "In(term" in plan
    stored.save_trigrams(docs, ["text"], f"{tmp_path}/g")
    ix = stored.Trigrams.load(spark, f"{tmp_path}/g")
    assert "In(gram" in ix.candidates("w12 w3")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("literal", ["w39", "W7 w", "STRASSE", "straße", "ΣΑΣ", "σας", "naïve", "k2", "zzz", "w", "", "ne\nth", "x" * 50])
def test_containing_equals_a_scan(docs, spark, tmp_path, literal):
    stored.save_trigrams(docs, ["text", "title"], f"{tmp_path}/g")
    ix = stored.Trigrams.load(spark, f"{tmp_path}/g")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = sorted(r.doc for r in docs.collect() if any(x is not None and literal.translate(fold) in x.translate(fold) for x in (r.text, r.title)))
    assert sorted(r.doc for r in stored.containing(ix, docs, ["text", "title"], literal).collect()) == want


@pytest.mark.parametrize(("pattern", "options"), [("w39", {}), ("w3[0-9] (w1|w2)", {}), ("(?i)the w7", {"context": 1}), ("last|line", {"context": 2}), ("w.", {}), ("w12", {"whole_word": True, "context": 3}), ("line", {"invert": True})])
def test_grep_equals_a_scan(docs, spark, tmp_path, pattern, options):
    stored.save_trigrams(docs, ["text"], f"{tmp_path}/g")
    ix = stored.Trigrams.load(spark, f"{tmp_path}/g")
    assert rows(stored.grep(ix, docs, pattern, **options)) == rows(text.grep(docs, pattern, **options))


def test_grep_gives_the_lines_around(spark):
    d = spark.createDataFrame([(1, "a\nb\nhit\nc\nhit"), (2, None), (3, "hit"), (4, "")], "doc long, text string")
    got = [(r.doc, r.line_no, r.before, r.after) for r in text.grep(d, "hit", context=2).orderBy("doc", "line_no").collect()]
    assert got == [(1, 3, "a\nb", "c\nhit"), (1, 5, "hit\nc", ""), (3, 1, "", "")]
    assert [(r.doc, r.line) for r in text.grep(d, "hit", context=1, invert=True).orderBy("doc", "line_no").collect()] == [(1, "a"), (1, "b"), (1, "c"), (4, "")]


def test_stemmed_blocks_equal_stems_by_hand(spark, tmp_path):
    import math

    notes = [(1, "licensing granted", "c", ["en"]), (2, "license grants granting", "c", ["en"]), (3, "relational databases", "d", []), (4, None, None, None)]
    d = spark.createDataFrame(notes, "doc long, content string, category string, tags array<string>")
    stored.save_blocks(search.note_index(d), str(tmp_path))
    ix = stored.Blocks.load(spark, str(tmp_path), stemmed=True)
    assert {r.term for r in ix.blocks.select("term").distinct().collect()} == {search.stem(w) for w in "licensing granted license grants granting relational databases c d en".split()}
    got = {r.doc: r.score for r in stored.top_k(ix, ["granted"], 5, search.NOTE_WEIGHTS, "any").collect()}
    n, avg = {1: 4, 2: 5}, (4 + 5 + 3 + 0) / 4
    idf = max(1e-6, math.log((4 - 2 + 0.5) / (2 + 0.5)))
    part = lambda f, dl: idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({1: part(10, n[1]), 2: part(20, n[2])})


def test_trigrams_lie_in_lists(docs, spark, tmp_path):
    """A gram has a row a batch, not a row a document, and the lists hold each document once for all columns."""
    stored.save_trigrams(docs, ["text", "title"], f"{tmp_path}/g")
    held = spark.read.parquet(f"{tmp_path}/g")
    want = {(r.doc, x.lower()[i : i + 3]) for r in docs.collect() for x in (r.text, r.title) if x and "Σ" not in x for i in range(len(x) - 2)}
    got = [(r.doc, r.gram) for r in held.select(F.explode("docs").alias("doc"), "gram").collect()]
    assert len(got) == len(set(got)) and {g for g in got if not set(g[1]) & set("σς")} >= want
    assert held.count() <= len({g for _, g in got}) * 4 < len(got)


def test_blocks_are_made_without_a_shuffle_of_tokens(docs, spark, tmp_path):
    """Postings of the plain index, a row for each document and word, are not read."""
    ix = search.index(docs, {"text": text.words(F.col("text"))})
    want = {(r.doc, r.term, r.text) for r in ix.postings.collect()}
    ix.postings = ix.lengths = None
    stored.save_blocks(ix, str(tmp_path), 20)
    blocks = stored.Blocks.load(spark, str(tmp_path)).blocks
    got = [(r.d, r.term, r.c) for r in blocks.select("term", F.explode(F.arrays_zip("docs", "text")).alias("x")).select("term", F.col("x.docs").alias("d"), F.col("x.text").alias("c")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
