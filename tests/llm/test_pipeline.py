import random

import pyarrow as pa
import pytest
from llm_fixtures import docs, prose

import corpus_pipeline
from tessera.llm import line_dedup, near_dedup
from tessera.llm.tokens import encoder, tokenizer_path


def test_each_stage_takes_effect(spark, tmp_path):
    rng = random.Random(9)
    footer = "This very line closes many of the documents."
    clean = [(i, f"{prose(i, 80 + i % 30)}\n{footer}", "en", f"src{i % 6}", 0) for i in range(60)]
    copies = [(100 + i, clean[i][1], "en", "src0", 0) for i in range(10)]
    junk = [(200 + i, " ".join(w + rng.choice(["###", "&&&"]) for w in prose(500 + i, 60).split()), "en", "src1", 0) for i in range(6)]
    df = docs(spark, clean + copies + junk + [(300, None, None, None, None), (301, "", "de", "src9", 0)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        rows = spark.read.parquet(f"{tmp_path}/out{k}")
        at[name] = rows
        assert name == "packing" or rows.columns == df.columns
    ids = lambda name: {r.doc_id for r in at[name].select("doc_id").collect()}
    assert ids("quality rules") == {i for i, *_ in clean + copies} | {300, 301}
    assert sum(footer in (r.text or "") for r in at["line dedup"].collect()) == 1 and at["line dedup"].count() == 72
    assert ids("near dedup") == {i for i, *_ in clean} | {300, 301}
    assert ids("mixing") <= ids("near dedup") and ids("packing") == ids("mixing") and len(ids("mixing")) > 40
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at["packing"].count()


def test_near_dedup_links_at_four_fifths(spark):
    words = prose(77, 104).split()
    copy = [f"changed{i}" if i in (35, 70) else w for i, w in enumerate(words)]
    shingles = [{tuple(w[i : i + 5]) for i in range(100)} for w in (words, copy)]
    assert 0.8 <= len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) < 0.85
    df = docs(spark, [(1, " ".join(words)), (2, " ".join(copy)), (3, prose(78, 104))])
    assert {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()} == {1, 3}


@pytest.mark.parametrize("work", [near_dedup._sketch, line_dedup._local(20, 3, 1000)])
def test_a_worker_drops_what_packing_remembers(work):
    """In the pipeline the workers that packed go on to other stages, with all they hold."""
    encoder(tokenizer_path(), *corpus_pipeline.REMEMBERED).encode([b"some words"])
    texts = [prose(i, 8) for i in range(2500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(2500), pa.int64()), "text": texts, "tk": pa.array([0] * 2500, pa.int64())})
    out = list(work(iter([batch])))
    assert encoder.cache_info().currsize == 0
    if work is near_dedup._sketch:
        assert [i for b in out for i in b.column(0).to_pylist()] == list(range(2500)) and max(b.num_rows for b in out) <= 1000
