"""Awkward inputs of the operators that other files don't try: extra columns, empty tables, very long prose, ties."""

import random

import numpy as np
import pytest
from llm_fixtures import ODD, docs, prose
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, packing, quality_classifier, substring_dedup, token_histogram


def test_extra_columns_do_not_clash(spark):
    names = ("piece", "bin", "at", "fill", "start", "length", "ids", "u", "quality", "block", "held_out", "n", "leaf", "_leaf", "_epochs", "epoch", "gone", "tk")
    df = docs(spark, ODD).withColumns({c: F.lit("clash") for c in names})
    plain = docs(spark, ODD)
    assert sorted(map(str, packing.pack(df).drop("sequence_id", "offset").collect())) == sorted(map(str, packing.pack(plain).drop("sequence_id", "offset").collect()))
    assert sorted(token_histogram.histogram(df).collect()) == sorted(token_histogram.histogram(plain).collect())
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    a, b = (quality_classifier.score(x, quality_classifier.fit(x, labels)).collect() for x in (df, plain))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_pipeline_of_an_empty_table_and_of_more_columns(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    rows = [(i, prose(i, 90), "en", f"src{i % 3}", 0) for i in range(12)]
    docs(spark, rows).withColumns({c: F.lit("clash") for c in ("_leaf", "gone", "posterior", "n_words")}).write.parquet(f"{tmp_path}/more/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/more").collect()} <= set(range(12))


def test_long_prose(spark):
    """Texts of 20,000 words: a passage at the far end is found, and the classifier reads it."""
    far = prose(1, 80)
    rows = [(1, prose(2, 20_000) + " " + far), (2, prose(3, 20_000) + " " + far), (3, prose(4, 300))]
    got = substring_dedup.passages(docs(spark, rows)).collect()
    assert [(r.a, r.b, r.a_start, r.a_end, r.b_start, r.b_end) for r in got] == [(1, 2, 20_000, 20_080, 20_000, 20_080)]
    x, y = quality_classifier.places(rows[0][1].encode()), quality_classifier.places((rows[0][1] + " odd!!!!WORD").encode())
    assert len(np.setdiff1d(y, x)) > 0


def by_hand(text: str) -> set[int]:
    """The classifier's places of a text, n-gram by n-gram."""
    words = [w.encode() for w in text.split()]
    return set(quality_classifier.places(b" ".join(words)).tolist())


def test_scores_equal_the_model_by_hand(spark):
    """Ratios from counts of all labelled training rows, and each score from its text's places, as plain Python has them."""
    rng = random.Random(4)
    rows = [(i, prose(i, 25) if i % 3 else prose(i, 25).upper()) for i in range(1, 90)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(1, 90) if rng.random() < 0.8] + [(5, 0, 0)]  # of several labels the largest counts
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(df, lab)
    import zlib

    truth = {}
    for i, y, _ in labels:
        if zlib.crc32(str(i).encode()) % 5:
            truth[i] = max(y, truth.get(i, 0))
    counts = np.ones((2, quality_classifier.PLACES))
    for i, y in truth.items():
        counts[y, list(by_hand(dict(rows)[i]))] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(ratios, model.ratios)
    for r in quality_classifier.score(df, model).collect():
        places = list(by_hand(dict(rows)[r.doc_id]))
        v = ratios[places] / np.linalg.norm(ratios[places])
        margin = float(model.weights[places] @ v) + model.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift)))) and r.predicted == int(r.score >= 0.3)


def test_packing_is_close_to_the_bound(spark):
    rows = [(i, prose(i, random.Random(i).randrange(20, 900))) for i in range(400)]
    got = packing.pack(docs(spark, rows).repartition(5), items=40).collect()
    total, used = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert used <= 1.03 * -(-total // packing.CAPACITY)


def test_a_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://there:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError):
        common.shared_folder(Session())
