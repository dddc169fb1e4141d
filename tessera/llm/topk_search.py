"""Exact top-k inner-product search by an impact-ordered index, score at a time.

The index is built once. A row block's postings are the components of its quantised vectors; they are put in order of
descending impact (magnitude, in steps), and the postings of one impact are a segment. Queries meet the blocks in blocks
of their own. Segments are processed by descending impact, all queries of the block at once, on the rows and components
that the segment has. Before each impact, what the segments still to come can add to a row is bounded by the impact times
the query's weight on the row's open components. A row stays a possible member while its upper bound reaches the k-th best
lower bound, of the block or of the whole index: a first pass over one block of rows gives every query a score that k rows
reach, so most blocks end early. Processing stops only when few possible members are left (or no segment is), and those
are scored anew, exactly, in integers.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id.
Shorter vectors count as filled up with zeros. Rows that repeat a vec_id and give one score are one candidate; a query
meets no row of its own vec_id. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .near_dedup import groups

K, SCALE, STEP = 5, 256.0, 16
ROW_BLOCK, QUERY_BLOCK = 2048, 1024

_FOUND = "query_id long, vec_id long, score long"


def valid(embedding: Column) -> Column:
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def quantised(vectors: list) -> np.ndarray:
    """floor(SCALE * x) of ragged vectors, filled up with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(SCALE * np.asarray(v, np.float64))
    return out


def ordered(rows: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings (places in the block, row by row) by descending impact, the impacts, and where each one's segment ends."""
    impact = (np.abs(rows) // step).ravel()
    order = np.argsort(-impact, kind="stable")
    levels, counts = np.unique(impact, return_counts=True)
    return order, levels[::-1], np.cumsum(counts[::-1])


def search_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K, step: int = STEP, few: int = 32, index=None, reached: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All possible members of the top k that the block has (indices of query and row, exact scores), and the impacts
    processed. reached: for each query a score that k rows of the whole index reach."""
    width = max(rows.shape[1], queries.shape[1])
    if rows.shape[1] < width:
        rows, index = np.pad(rows, ((0, 0), (0, width - rows.shape[1]))), None
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    order, levels, ends = index or ordered(rows, step)
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    kind = np.float32 if largest < 2**23 else np.float64  # sums stay exact below 2^23 and 2^53; beyond, bounds are widened
    slack = largest * 2.0**-48 if largest >= 2**53 else 0.0
    weights = queries.astype(kind)
    size = np.abs(weights)
    flat, segment = rows.ravel(), np.zeros(rows.shape, kind)
    open_ = np.ones(rows.shape, kind)
    done = np.zeros((len(queries), len(rows)), kind)
    own = query_ids[:, None] == ids[None, :]
    by_id = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id[:1]] - 1)) if len(ids) else by_id
    per_id = (lambda x: x) if len(first) == len(ids) else (lambda x: np.maximum.reduceat(x[:, by_id], first, axis=1))  # an id's rows count once
    k_row = min(k, len(first))
    floor = np.full(len(queries), -np.inf) if reached is None else reached.astype(np.float64)

    def least(lower):
        """What the k-th best row has at least, here or anywhere."""
        here = np.partition(per_id(lower), len(first) - k_row, axis=1)[:, len(first) - k_row] if k_row == k else np.full(len(queries), -np.inf)
        return np.maximum(here, floor)[:, None]

    possible, used, start = ~own, 0, 0
    for t, end in enumerate(ends.tolist()):
        places = order[start:end]
        start = end
        r, c = np.divmod(places, width) if width else (places, places)
        some_r, some_c = np.unique(r), np.unique(c)
        segment[r, c] = flat[places]
        done[:, some_r] += weights[:, some_c] @ segment[np.ix_(some_r, some_c)].T
        segment[r, c] = 0
        open_[r, c] = 0
        used += 1
        if levels[t] == 0 or t + 1 == len(levels):
            break
        if t % 2 and t < len(levels) - 3:
            continue
        rest = (size @ open_.T).astype(np.float64) * (float(levels[t + 1]) * step + step - 1) + slack
        possible = (done + rest >= least(np.where(own, -np.inf, done - rest))) & ~own
        if possible.sum() <= few * len(queries):
            break
    if len(levels) and used == len(levels) and not slack:  # every segment is in: done is exact
        possible = (done >= least(np.where(own, -np.inf, done))) & ~own
    q, r = np.nonzero(possible)
    scores = np.empty(len(q), np.int64)
    for at in range(0, len(q), 100_000):
        s = slice(at, at + 100_000)
        scores[s] = np.einsum("ij,ij->i", queries[q[s]], rows[r[s]])
    return q, r, scores, used


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best distinct (score, id)."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    order, q = order[fresh], q[fresh]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def _build(batches):
    """A row block's vectors as one record of the index."""
    for (rb,), held in groups(batches, ["rb"], ["vec_id", "embedding"]):
        ids, rows = np.array([i for i, _ in held], np.int64), quantised([v for _, v in held])
        order, levels, ends = ordered(rows)
        parts = [ids, rows, order.astype(np.uint32), levels, ends]
        kinds = [pa.binary()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([rb], pa.int32()), pa.array([rows.shape[1]], pa.int32()), *(pa.array([x.tobytes()], k) for x, k in zip(parts, kinds, strict=True))], _INDEX_NAMES)


_INDEX = "rb int, width int, ids binary, vectors binary, postings binary, levels binary, ends binary"
_INDEX_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def _search(k: int):
    """A block of the index (its record comes first) and the queries that met it."""

    def run(batches):
        for _, held in groups(batches, ["rb", "qb"], ["width", "ids", "vectors", "postings", "levels", "ends", "vec_id", "embedding", "reached"]):
            block, asks = [h for h in held if h[1] is not None], [h for h in held if h[1] is None]
            if not block or not asks:
                continue
            width, ids, vectors, postings, levels, ends = block[0][:6]
            ids, levels, ends = (np.frombuffer(x, np.int64) for x in (ids, levels, ends))
            rows = np.frombuffer(vectors, np.int64).reshape(len(ids), width)
            query_ids = np.array([h[6] for h in asks], np.int64)
            reached = np.array([-np.inf if h[8] is None else float(h[8]) for h in asks])
            q, r, scores, _ = search_block(ids, rows, query_ids, quantised([h[7] for h in asks]), k, index=(np.frombuffer(postings, np.uint32).astype(np.int64), levels, ends), reached=reached)
            keep = _best(q, ids[r], scores, k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_ids[q[keep]], ids[r[keep]], scores[keep])], ["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, row_block: int = ROW_BLOCK) -> tuple[DataFrame, int]:
    """The index of vectors (vec_id, embedding), a record a block, and its number of blocks."""
    n = max(1, -(-vectors.count() // row_block))
    rows = vectors.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n)).cast("int").alias("rb"), "vec_id", "embedding")
    return cut(rows.repartition("rb").sortWithinPartitions("rb").mapInArrow(_build, _INDEX)), n


def _asked(index: DataFrame, asks: DataFrame, blocks, qbs: int, k: int) -> DataFrame:
    """What blocks (a column of their numbers) of the index have for the queries (qb, vec_id, embedding, reached)."""
    none = lambda t: F.lit(None).cast(t)
    left = index.select("rb", F.explode(F.sequence(F.lit(0), F.lit(qbs - 1))).alias("qb"), *_INDEX_NAMES[1:], none("long").alias("vec_id"), none("array<double>").alias("embedding"), none("long").alias("reached"))
    right = asks.select(F.explode(blocks).alias("rb"), "qb", *(none(t.split()[1]).alias(t.split()[0]) for t in _INDEX.split(", ")[1:]), "vec_id", "embedding", "reached")
    return left.union(right).repartition("rb", "qb").sortWithinPartitions("rb", "qb").mapInArrow(_search(k), _FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the highest integer inner product."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    v = v.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    index, n = build_index(v, row_block)
    asks = v.where("asks").dropDuplicates(["vec_id", "embedding"]).select("vec_id", "embedding")
    qbs = max(1, -(-asks.count() // query_block))
    asks = cut(asks.select(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(qbs)).cast("int").alias("qb"), "vec_id", "embedding", F.lit(None).cast("long").alias("reached")))
    found = cut(_asked(index.where("rb = 0"), asks, F.array(F.lit(0)), qbs, k))  # one block of rows, all queries
    if n > 1:
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = found.distinct().withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("k_th"))
        known = asks.join(kth, "vec_id", "left").select("qb", "vec_id", "embedding", F.col("k_th").alias("reached"))
        found = found.unionAll(_asked(index.where("rb > 0"), known, F.sequence(F.lit(1), F.lit(n - 1)), qbs, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
