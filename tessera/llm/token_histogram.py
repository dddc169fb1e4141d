"""Exact histogram of encoded lengths, and what suffix sums over it answer for every context limit.

Map tasks count their own documents by length, so only (length, count) pairs are shuffled. Suffix sums run in two
steps, within blocks of lengths and over the blocks, so no task sees more than a block.

Edge cases: a null text is an empty one of length 0. Ids take no part, so null or repeated ones change nothing. An
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of
from .tokens import encoder, tokenizer_path

BLOCK = 256


def _lengths(path: str):
    def run(batches):
        encode, found = encoder(path).encode, Counter()
        for batch in batches:
            texts = column_of(batch, "text", "binary")
            for lo in range(0, len(texts), 512):
                found.update(len(x) // 4 for x in encode([t or b"" for t in texts[lo : lo + 512]]))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["length", "n_docs"])

    return run


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs): documents by the number of their token ids."""
    counts = docs.select("text").mapInArrow(_lengths(tokenizer or tokenizer_path()), "length long, n_docs long")
    return counts.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs: documents and tokens at least that long, tokens if every document is cut there.

    n_longer and tokens_longer count documents of more than this length; total_truncated is the sum of
    min(length, this length) over all documents; quantile is the share of documents of at most this length.
    """
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / block).alias("_k"))
    blocks = h.groupBy("_k").agg(F.sum("n_docs").alias("_n"), F.sum("tokens").alias("_t"))
    above = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)  # over blocks of lengths, not documents
    everything = Window.partitionBy()
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "_k", F.coalesce(F.sum("_n").over(above), zero).alias("_na"), F.coalesce(F.sum("_t").over(above), zero).alias("_ta"), F.sum("_n").over(everything).alias("n_total"), F.sum("_t").over(everything).alias("tokens_total")
    )
    within = Window.partitionBy("_k").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(blocks, "_k").select(
        "length", "n_docs", "tokens", "n_total", "tokens_total",
        (F.coalesce(F.sum("n_docs").over(within), zero) + F.col("_na")).alias("n_longer"),
        (F.coalesce(F.sum("tokens").over(within), zero) + F.col("_ta")).alias("tokens_longer"),
    )
    return out.select(
        "length", "n_docs", "tokens", "n_longer", "tokens_longer",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("length") * F.col("n_longer")).alias("total_truncated"),
        ((F.col("n_total") - F.col("n_longer")) / F.col("n_total")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> Column | DataFrame:
    """Tokens left if every document is cut at `limit`: one row, from one row of the sums."""
    nearest = sums.where(F.col("length") <= limit).agg(F.max_by(F.struct("length", "total_truncated", "n_longer"), "length").alias("x"))
    n_all = sums.agg(F.max(F.col("n_longer") + F.col("n_docs")).alias("n"))
    beyond = F.col("x.total_truncated") + (F.lit(limit) - F.col("x.length")) * F.col("x.n_longer")
    return nearest.crossJoin(n_all).select(F.lit(limit).cast("long").alias("limit"), F.coalesce(beyond, F.col("n") * limit, F.lit(0)).cast("long").alias("tokens"))


def quantile_length(sums: DataFrame, share: float) -> DataFrame:
    """The least length that at least this share of the documents does not exceed: one row."""
    return sums.where(F.col("quantile") >= share).agg(F.min("length").alias("length"))
