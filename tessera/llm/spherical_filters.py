"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction on the sphere, and catches the vectors whose cosine with it reaches a limit. Directions come from
structured random product codes: a code rotates vectors by three rounds of random signs and a Hadamard transform, splits
them in halves, and has WORDS random unit vectors for either half; every pair of them is one direction, so WORDS ** 2
filters are known by 2 * WORDS products. A vector is list-decoded: codewords of the first half from which no pair could
reach the limit are left out, and the others meet all of the second. A vector that fewer than FEWEST filters catch takes
its FEWEST nearest ones. Two vectors that share a filter are candidates, and are compared exactly, in double precision.
With CODES codes of WORDS words and a limit of LIMIT deviations a vector has about 36 filters. Of 6,000 random pairs in 64
dimensions 2 shared no filter at a cosine of 0.9, and none from 0.94 on. LIMIT is the trade between filters and
candidates; it depends on neither the data nor their number.

Equal vectors are one node. A filter with many nodes is split in blocks, and each two of its blocks are compared as
matrices; what leaves a comparison is a count and one edge for each node, never pairs. A pair is counted in the first
filter that both have, which their lists of filters tell, so counts over all filters are exact.

Edge cases: vectors that are null or zero, or hold null or non-finite components, link with nothing, nor do rows with a
null vec_id (their component is null, and they are kept). Shorter vectors count as filled up with zeros. Rows that repeat
a vec_id are vectors each. An empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, cut, slices
from .graph import components
from .topk_search import valid

CODES, WORDS, LIMIT, FEWEST, LEAST_WIDTH, SEED = 16, 160, 3.6, 24, 64, 12
#: Nodes of one filter that are compared as one block.
BLOCK = 1024

_DECODED = "node long, filters array<long>"
_LINKS = "node long, root long, links long"


def _width(n: int) -> int:
    """The power of two that n components are filled up to, LEAST_WIDTH at least."""
    return max(LEAST_WIDTH, 1 << (max(n, 1) - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(2)
def product_codes(width: int, n: int = CODES, words: int = WORDS, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each code the signs of its rotation, and the codewords of its halves (as columns, of length 1 / sqrt(2))."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        signs = rng.choice([-1.0, 1.0], (3, width))
        halves = rng.standard_normal((2, width // 2, words))
        halves /= np.linalg.norm(halves, axis=1, keepdims=True) * np.sqrt(2)
        out.append((signs, halves[0], halves[1]))
    return out


def _caught(x: np.ndarray, codes: list, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, filter, cosine) of every filter that is at least so near to a row of x."""
    out, half = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], x.shape[1] // 2
    for c, (signs, first, second) in enumerate(codes):
        y = x
        for s in signs:
            y = hadamard(y * s)
        one, two = y[:, :half] @ first, y[:, half:] @ second
        r, i = np.nonzero(one >= least - two.max(1, keepdims=True))
        for at in range(0, len(r), 20_000):
            rs, is_ = r[at : at + 20_000], i[at : at + 20_000]
            both = one[rs, is_][:, None] + two[rs]
            k, j = np.nonzero(both >= least)
            out.append((rs[k], (c * first.shape[1] + is_[k]) * first.shape[1] + j, both[k, j]))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def decoded(x: np.ndarray, codes: list, limit: float = LIMIT, fewest: int = FEWEST) -> list[np.ndarray]:
    """Of each unit vector (a row) the numbers of all filters that catch it, and of its `fewest` nearest ones anyway; in
    ascending order."""
    fewest = min(fewest, len(codes) * codes[0][1].shape[1] ** 2)
    rows, found, _ = _caught(x, codes, limit / np.sqrt(x.shape[1]))
    few = np.flatnonzero(np.bincount(rows, minlength=len(x)) < fewest)
    stays = ~np.isin(rows, few)
    parts, lower = [(rows[stays], found[stays])], limit
    while len(few):
        lower -= 0.5
        r, f, cos = _caught(x[few], codes, lower / np.sqrt(x.shape[1]))
        enough = np.bincount(r, minlength=len(few)) >= fewest
        order = np.lexsort((f, -cos, r))
        r, f = r[order], f[order]
        best = (np.arange(len(r)) - np.searchsorted(r, r) < fewest) & enough[r]
        parts.append((few[r[best]], f[best]))
        few = few[~enough]
    rows, found = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((found, rows))
    return np.split(found[order], np.searchsorted(rows[order], np.arange(1, len(x))))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Rows are brought to a largest component of 1 first, so that squares neither over- nor underflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode(width: int, limit: float, fewest: int, n: int, words: int):
    def run(batches):
        codes = product_codes(width, n, words)
        for batch in slices(batches, 512):
            nodes, vectors = column_of(batch, "node"), column_of(batch, "embedding")
            lists = decoded(units(_matrix(vectors, width)), codes, limit, fewest) if nodes else []
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], ["node", "filters"])

    return run


def _earlier(filters: list[np.ndarray], now: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of left and right (indices of filters) have a filter before `now` in common."""
    used = np.unique(np.concatenate([left, right]))
    at = np.full(len(filters), -1)
    at[used] = np.arange(len(used))
    lists = [filters[k][filters[k] < now] for k in used]
    names, column = np.unique(np.concatenate([*lists, np.empty(0, np.int64)]), return_inverse=True)
    has = np.zeros((len(used), len(names)), np.float32)
    has[np.repeat(np.arange(len(used)), [len(x) for x in lists]), column] = 1
    return has[at[left]] @ has[at[right]].T > 0


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n members' component, of links (a, b) both ways."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as their values, and where each one ends."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))


def _arrays(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """A batch's keys (a row each), nodes, weights, blocks, unit vectors and lists of filters."""
    values, ends = _lists(batch, "embedding")
    lengths = np.diff(ends, prepend=0)
    x = np.zeros((batch.num_rows, width))
    x[np.arange(width) < lengths[:, None]] = values
    filters, ends = _lists(batch, "filters")
    each = np.empty(batch.num_rows, object)
    each[:] = np.split(filters, ends[:-1])
    keys = np.stack([_numbers(batch, c) for c in ("filter", "i", "j")], 1).astype(np.int64)
    return [keys, _numbers(batch, "node"), _numbers(batch, "weight"), _numbers(batch, "own"), units(x), each]


def _groups(batches, width: int):
    """The arrays of each run of rows with equal keys, over the borders of batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _arrays(batch, width)
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        starts = np.flatnonzero((now[0][1:] != now[0][:-1]).any(1)) + 1
        for lo, hi in zip([0, *starts[:-1].tolist()], starts.tolist(), strict=True) if len(starts) else ():
            yield [x[lo:hi] for x in now]
        held = [x[starts[-1] if len(starts) else 0 :] for x in now]
    if held is not None:
        yield held


def _compare(percent: float, width: int):
    """Nodes of two blocks of a filter (or of one): links that no earlier filter counts, and an edge to a node of its component."""

    def run(batches):
        for keys, nodes, weight, own, unit, filters in _groups(batches, width):
            now, i, j = keys[0].tolist()
            if i == j:
                left = right = np.arange(len(nodes))
                hit = unit @ unit.T >= percent / 100
                np.fill_diagonal(hit, False)
            else:
                left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
                hit = unit[left] @ unit[right].T >= percent / 100
            if not hit.any():
                continue
            a, b = np.nonzero(hit)
            root = _roots(len(nodes), np.concatenate([left[a], right[b]]), np.concatenate([right[b], left[a]]))
            some, other = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            fresh = hit[np.ix_(some, other)] & ~_earlier(filters, now, left[some], right[other])
            links = np.zeros(len(nodes), np.int64)
            links[left[some]] += fresh @ weight[right[other]]
            if i != j:
                links[right[other]] += fresh.T @ weight[left[some]]
            held = np.unique(np.concatenate([left[some], right[other]]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[held], nodes[root[held]], links[held])], ["node", "root", "links"])

    return run


def distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, k1, k2), keys null where they take no part, and the nodes (node, k1, k2, weight, least, embedding)."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    takes_part = F.col("vec_id").isNotNull() & valid(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    keys = [F.when(takes_part, F.xxhash64(F.lit(k), "embedding")).alias(f"k{k}") for k in (1, 2)]
    all_rows = v.select("vec_id", *keys, "embedding")
    same = all_rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.any_value("embedding").alias("embedding"))
    return all_rows.drop("embedding"), cut(same.withColumn("node", F.monotonically_increasing_id()))


def candidates(nodes: DataFrame, width: int, limit: float = LIMIT, fewest: int = FEWEST, block: int = BLOCK, codes: int = CODES, words: int = WORDS) -> DataFrame:
    """(filter, i, j, node, weight, own, filters, embedding): nodes of each two blocks of each filter that catches several,
    dealt and sorted. own is a node's block."""
    lists = cut(nodes.select("node", "embedding").mapInArrow(_decode(width, limit, fewest, codes, words), _DECODED))
    caught = lists.select("node", F.explode("filters").alias("filter"))
    sizes = caught.groupBy("filter").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    at = caught.join(sizes, "filter").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    at = at.select("filter", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    at = at.select("filter", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = nodes.select("node", "weight", "embedding").join(lists, "node")
    return at.join(full, "node").repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")


def near_vectors(vectors: DataFrame, percent: float = 90, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: the other vectors with a cosine of `percent` hundredths or more,
    the smallest vec_id that such links reach, and whether it is the row's own."""
    all_rows, nodes = distinct(vectors)
    width = _width(nodes.agg(F.max(F.size("embedding"))).first()[0] or 1)
    found = cut(candidates(nodes, width, **options).mapInArrow(_compare(percent, width), _LINKS))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = cut(nodes.select("node", "k1", "k2", "weight", "least").join(links, "node").join(labels, "node"))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "label").select("k1", "k2", "weight", "links", "component_id")
    copies = nodes.join(found.select("node").distinct(), "node", "left_anti").where("weight > 1")
    linked = linked.unionAll(copies.select("k1", "k2", "weight", F.lit(0).cast("long"), "least"))
    out = all_rows.join(linked, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    n_links: Column = F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
