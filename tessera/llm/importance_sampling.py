r"""Importance resampling of documents toward a target set, by hashed n-grams.

Words are runs of digits, letters a-z and characters beyond ASCII, after A-Z became a-z; features are runs of 1 to `ngram`
consecutive words, joined by one space, and fall into BUCKETS by their CRC-32. A bucket's gain is the logarithm of its
share of the target's features over its share of all documents', add-one smoothed, in whole thousandths. Gains are an
array that the scoring tasks look buckets up in; a document's weight is the sum over its features. Its score adds a
Gumbel variate of its id's hash, so that the highest scores are a sample without replacement in proportion to exp(weight).

Scores are whole numbers. An exact histogram of them has a row a score; its suffix sums say how many rows score higher,
which gives the cut-off score and the rank at which every surviving score begins. Within a score row_number over doc_id
gives the ranks; ids are counted in ranges of 2^20 first, so that a score that many documents share is no single group.

Edge cases: null and empty texts have no features, and weight 0. A document whose id is null hashes as an empty id; it
comes after all others of its score. Rows that repeat an id are documents each, and get ranks one after the other. An empty table gives no rows. Without documents of
`min_words` words nothing is drawn. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, cut, slices

BUCKETS, NGRAM, MIN_WORDS, SEED = 10_000, 1, 20, 2024
#: Ids of one range, and the most bands that scores are dealt into for their suffix sums.
ID_BITS, BANDS = 20, 4096

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def buckets_of(text: bytes, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each feature of a whole text."""
    words = text.translate(_WORD_BYTES).split()
    found = list(map(zlib.crc32, words))
    for n in range(2, ngram + 1):
        found += [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.array(found, np.int64) % buckets


def n_words(text: bytes) -> int:
    return len(text.translate(_WORD_BYTES).split())


def _counted(ngram: int, buckets: int):
    """Each task's features by bucket: a row a bucket, however many documents the task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in column_of(batch, "text", "binary"):
                if text:
                    total += np.bincount(buckets_of(text, ngram, buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; `buckets` numbers reach the driver."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(ngram, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets)))) of each bucket."""
    t_all, s_all, n = float(target.sum()), float(source.sum()), len(target)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray, ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            features, words, weights = [], [], []
            for text in column_of(batch, "text", "binary"):
                found = buckets_of(text or b"", ngram, len(gain))
                features.append(len(found))
                words.append(len(found) if ngram == 1 else n_words(text or b""))
                weights.append(int(gain[found].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (features, words, weights))], ["doc_id", "n_features", "words", "weight"])

    return run


def weighed(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """(doc_id, n_features, words, weight) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_weighed(gain, ngram), "doc_id long, n_features long, words long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of SHA-256 of `seed:doc_id`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((digits + 0.5) / 4294967296.0))).cast("long")


def histogram(rows: DataFrame) -> DataFrame:
    """(score, n, higher) of rows with a score: how many rows have it, and how many a higher one. Suffix sums are taken in
    bands of scores, and over the bands, whose number is bounded."""
    hist = cut(rows.groupBy("score").agg(F.count("*").alias("n")))
    least, most = hist.agg(F.min("score"), F.max("score")).first()
    width = 1 if least is None else (most - least) // BANDS + 1
    hist = hist.withColumn("band", F.floor((F.col("score") - F.lit(least or 0)) / F.lit(width)).cast("long"))
    above = Window.rowsBetween(Window.unboundedPreceding, -1)
    bands = hist.groupBy("band").agg(F.sum("n").alias("in_band"))  # BANDS rows at most
    bands = bands.select("band", F.coalesce(F.sum("in_band").over(above.orderBy(F.desc("band"))), F.lit(0)).alias("over"))
    inner = F.coalesce(F.sum("n").over(above.partitionBy("band").orderBy(F.desc("score"))), F.lit(0))
    return hist.select("score", "n", "band", inner.alias("inner")).join(F.broadcast(bands), "band").select("score", "n", (F.col("inner") + F.col("over")).alias("higher"))


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """rows (doc_id, score, ..) that are among the `draw` of the highest scores, ties to smaller ids, with their rank."""
    hist = cut(histogram(rows))
    cutoff = hist.where(F.col("higher") < draw).agg(F.min("score")).first()[0]
    ids = F.when(F.col("doc_id").isNull(), F.lit(2**62)).otherwise(F.shiftright("doc_id", ID_BITS))
    some = rows.where(F.col("score") >= F.lit(cutoff)).withColumn("ids", ids)
    upto = Window.partitionBy("score").orderBy("ids").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy("score", "ids").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
    starts = starts.join(hist, "score").select("score", "ids", (F.col("higher") + F.col("before")).alias("start"))
    within = F.row_number().over(Window.partitionBy("score", "ids").orderBy(F.col("doc_id").asc_nulls_last()))
    out = some.join(starts, ["score", "ids"]).withColumn("rank", F.col("start") + within)
    return out.where(F.col("rank") <= draw).drop("ids", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = MIN_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; rank is null where the document wasn't drawn. `percent` of the
    documents with `min_words` words are."""
    gain = gains(counts(target, ngram, buckets), counts(docs, ngram, buckets))
    scored = weighed(docs, gain, ngram).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = cut(scored.select(F.monotonically_increasing_id().alias("row"), "*"))
    may = scored.where(F.col("words") >= min_words)
    draw = may.count() * percent // 100
    names = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    drawn = cut(ranked(may.select("row", "doc_id", "score"), draw).select(F.col("row").alias("drawn"), "rank"))
    return scored.join(drawn, F.col("row") == F.col("drawn"), "left").select(*names, F.col("rank").cast("long").alias("rank"))
