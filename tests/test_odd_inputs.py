"""Odd inputs and larger tables on which queries once differed from their SQL or grew out of bounds."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import alike, memory, paths, quality, report, text


def test_words_of_security_rules_end_at_other_letters(spark):
    lines = ["éDES", "DESé", "漢MD5漢", "xDES", "DES_", "(RC4)"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc long, line_no int, line string")
    assert sorted(r.line_no for r in quality.security_hits(rows).where("rule = 'weak_crypto'").collect()) == [0, 1, 2, 5]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc long, text string")
    assert sorted(r.line_no for r in text.grep(docs, "DES", whole_word=True).collect()) == [1, 2]


def test_rounded_scores_of_notes_go_by_id(spark):
    notes = spark.createDataFrame([(2, 0.5000000002), (1, 0.5), (3, 0.9)], "id long, importance double")
    got = memory.recall(notes, F.lit(0.0), F.col("importance"), F.lit(0.0), 2, digits=6).collect()
    assert [(r.id, r.score) for r in got] == [(3, pytest.approx(0.47)), (1, pytest.approx(0.35))]


def test_pages_of_one_url_are_files_of_their_own(spark, tmp_path):
    from tessera.plans import stream_queries

    pages = [(3, "u3", "a"), (4, "twice", "b"), (5, "twice", "c"), (6, "again", "d"), (53, "again", "e")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = stream_queries.s11_incremental_snapshot(spark, str(tmp_path)).collect()
    h = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter([("u3", h("u3")), ("twice", h("c")), ("again", h("d")), ("again", h("again"))])


def test_many_symbols_of_equal_lines(spark):
    """80,000 classes and as many methods of one file: their pairs, 6.4 thousand million of them, are never made."""
    n = spark.range(160_000).select(
        F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.when(F.col("id") % 2 == 0, "class").otherwise("method").alias("type"), F.lit("/a.py").alias("filePath"), F.lit(True).alias("isExported"), F.lit("public").alias("visibility"),
        (F.col("id") / 2 % 9).cast("int").alias("startLine"), (F.col("id") / 2 % 9 + 3).cast("int").alias("endLine"), F.lit("s").alias("signature"),
    ).withColumn("name", F.col("id"))
    rows = [r.asDict() for r in report.abstractions(n, 1).where("kind = 'class'").collect()]
    assert rows == [{"kind": "class", "name": "n000000", "filePath": "/a.py", "methods": 8889}]
    wide = n.withColumn("endLine", F.when(F.col("id") == "n000000", 99).otherwise(F.col("endLine")))
    assert Counter(r.line for r in report.skeleton(wide, "/a.py").collect()) == {"s": 1, "  s": 159_999}


def test_conflicts_go_by_groups(spark):
    """100 word sets with each of 100 tag sets, all alike enough together only: 50 million pairs, of which none is made."""
    i = F.col("id")
    d = spark.range(10_000).select("id", F.lit("active").alias("status"), F.concat(F.lit("common x"), (i % 100).cast("string")).alias("title"), F.lit("").alias("description"), F.array(F.lit("all"), F.concat(F.lit("t"), F.floor(i / 100).cast("string"))).alias("tags"))
    got = alike.conflict_classes(d, 0.3).groupBy("n_links", "class_id").count().collect()
    assert [tuple(r) for r in got] == [(9999, 0, 10_000)]


def test_cycles_shuffle_no_paths_that_do_not_meet(spark):
    """4,000 symbols with 20 moves each: half a million paths of two moves, some millions of three."""
    name = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 5, "0"))
    m = spark.range(80_000).select(name(F.col("id") % 4000).alias("src"), name(F.pmod(F.xxhash64("id"), F.lit(4000))).alias("dst"))
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = written()
    assert paths.cycles(m, 4).count() > 1000
    assert written() - before < 30_000_000


def test_parts_of_one_brand_conflict(spark, tmp_path):
    """Whatever their size and name; parts of other brands by their words, and parts without a brand too."""
    import duckdb

    from tessera.plans import catalog

    rows = [(1, "red ring", "Brand#1", "LARGE", 1), (2, "blue bolt", "brand#1", "SMALL", 2), (3, "green nut", "Brand#2", "TINY", 1), (4, "green nut", "Brand#3", "TINY", 7), (5, "odd part", None, "ONE", 3), (6, "odd part", None, "ONE", 4), (7, "lone pin", "Brand#4", "FLAT", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["d1_conflicts"](spark, str(tmp_path)).select("id", "n_links", "class_id").collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 0, 7)]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        assert sorted(db.execute(f"SELECT id, n_links, class_id FROM ({catalog.oracle_sql()['d1_conflicts']})").fetchall()) == got


def test_sets_of_long_words_are_small_on_disk(spark):
    """Sets are written as 8 bytes a word, however long the words are."""
    long = F.expr("transform(sequence(1, 50), i -> concat(repeat('x', 200), id, '-', i))")
    sets, one = text.token_sets(spark.range(100).select(F.col("id").alias("doc"), long.alias("w")), F.col("w"))
    assert one.select(F.sum(F.size("w"))).first()[0] == 5000 and sets.count() == 100
    assert one.select(F.max(F.length(F.to_json(F.struct("w"))))).first()[0] < 50 * 22
