"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct 5-word shingles. Documents with equal sets fall together first, by a 128-bit
digest, so copies cost nothing further. The rest get 128 minima: bands of five give bucket keys, and the low four bits
of each minimum, packed to 64 bytes, give the similarity estimate, corrected for chance agreement. Inside a bucket,
a search over the not yet reached members (never all pairs) yields a spanning forest of pairs whose estimate is high
enough; a large bucket is searched in pairs of blocks, so no task holds more than two. Components of these edges are candidate groups; each is confirmed on full shingle sets in blocks of about
`block` members, every pair of blocks in one small task, again as a spanning forest of exact links. Components of the
exact links are the result.

At 100 * |A & B| >= 85 * |A | B| a link escapes the 25 bands with probability 4e-7 and the estimate's margin with 2e-8.

Edge cases: without words a document has no shingles and links with nothing. Rows with a null doc_id link with nothing,
have no component and are kept. Rows that repeat a doc_id share a node if their sets are equal; each row is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, cut, fresh, slices
from .graph import components

WORDS, PERCENT = 5, 85
MINIMA, ROWS, BANDS, BITS = 128, 5, 25, 4
#: Standard errors (of the estimate, at the limit) that a candidate's estimate may lie below the limit.
MARGIN = 5.5
#: Members and shingles of a block of a candidate group.
BLOCK, BLOCK_SHINGLES = 100, 200_000
#: Members of a block of a band's bucket.
BUCKET = 1024

_SKETCH = "doc_id long, n_shingles long, digest binary, bits binary, bands array<long>"
_EDGES = "a binary, b binary"


def _mixed(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers by a splitmix rule."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


_TIMES, _XOR, _P = _mixed(MINIMA, 1), _mixed(MINIMA, 1000), np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z in lower case."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    z = h[:n].copy()
    for k in range(1, words):
        z *= _P
        z += h[k : k + n]
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    return np.unique(z)


def minima(z: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(z), 2048):
        y = (z[at : at + 2048, None] ^ _XOR) * _TIMES
        y ^= y >> np.uint64(32)
        np.minimum(out, y.min(0), out=out)
    return out


def packed_bits(m: np.ndarray) -> bytes:
    """The low BITS bits of each minimum, packed."""
    low = (m & np.uint64(2**BITS - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def band_keys(m: np.ndarray) -> list[int]:
    raw = np.ascontiguousarray(m)
    return [int.from_bytes(xxhash.xxh3_64_digest(raw[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b), "big", signed=True) for b in range(BANDS)]


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature (8 words of 64 bits) with others, corrected for agreement by chance."""
    x = many ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1)
    chance = 2.0**-BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    j, chance = percent / 100, 2.0**-BITS
    p = j + (1 - j) * chance
    return j - MARGIN * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def forest(n: int, linked) -> list[tuple[int, int]]:
    """Spanning forest over 0..n-1: linked(i, rest) says which of rest are linked with i. Pairs once reached aren't compared."""
    rest, edges = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            found = rest[hit].tolist()
            rest = rest[~hit]
            edges += [(i, j) for j in found]
            queue += found
    return edges


def groups(batches, keys: list[str], values: list[str]):
    """Runs of rows with equal keys, over the borders of batches."""
    key, held = None, []
    for batch in slices(batches):
        k = list(zip(*(column_of(batch, c) for c in keys), strict=True))
        for now, row in zip(k, zip(*(column_of(batch, c, "binary" if c == "text" else None) for c in values), strict=True), strict=True):
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(row)
    if held:
        yield key, held


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _sketch(batches):
    for batch in slices(batches):
        rows = []
        for i, t in zip(column_of(batch, "doc_id"), column_of(batch, "text", "binary"), strict=True):
            z = shingles(t or b"")
            if len(z):
                m = minima(z)
                rows.append((i, len(z), xxhash.xxh3_128_digest(z.tobytes()), packed_bits(m), band_keys(m)))
            else:
                rows.append((i, 0, b"", b"", []))
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _SKETCH.split(", ")])


def _bucket_forest(least: float):
    def run(batches):
        pairs = []
        for _, rows in groups(batches, ["key", "i", "j"], ["digest", "bits"]):
            sig = np.frombuffer(b"".join(r[1] for r in rows), np.uint64).reshape(len(rows), -1)
            pairs += [(rows[i][0], rows[j][0]) for i, j in forest(len(rows), lambda i, rest: estimates(sig[i], sig[rest]) >= least)]
            if len(pairs) > 20_000:
                yield _edges(pairs)
                pairs = []
        yield _edges(pairs)

    return run


def exact_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the exact links of some sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(owner) else owner
    starts = np.cumsum(sizes) - sizes
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)

    def linked(i, rest):
        mine = ids[starts[i] : starts[i] + sizes[i]]
        seen[mine] = True
        if 4 * len(rest) < len(sets):
            both = np.array([int(seen[ids[starts[j] : starts[j] + sizes[j]]].sum()) for j in rest])
        else:
            both = np.bincount(owner[seen[ids]], minlength=len(sets))[rest]
        seen[mine] = False
        return 100 * both >= percent * (sizes[i] + sizes[rest] - both)

    return forest(len(sets), linked)


def _confirm(percent: int):
    def run(batches):
        pairs = []
        for _, rows in groups(batches, ["label", "i", "j"], ["digest", "text"]):
            found = {}
            for digest, text in rows:
                if digest not in found:
                    z = shingles(text or b"")
                    if xxhash.xxh3_128_digest(z.tobytes()) == digest:  # else a row that only shares the doc_id
                        found[digest] = z
            names = list(found)
            pairs += [(names[a], names[b]) for a, b in exact_forest(list(found.values()), percent)]
            if len(pairs) > 20_000:
                yield _edges(pairs)
                pairs = []
        yield _edges(pairs)

    return run


def sketches(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch, _SKETCH)


def candidate_edges(nodes: DataFrame, percent: int = PERCENT, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of digests: spanning forests of the pairs of each band's buckets with a high enough estimate. A large bucket
    is compared in pairs of blocks, each in a task of its own; together their forests hold every pair's ends in one tree."""
    rows = nodes.select("digest", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / bucket).cast("int").alias("blocks"))
    shared = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    others = F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE filter(sequence(0, blocks - 1), x -> x <> own) END")
    shared = shared.select("digest", "key", "own", F.explode(others).alias("other"))
    shared = shared.select("digest", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = shared.join(nodes.select("digest", "bits"), "digest").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "digest")
    return full.mapInArrow(_bucket_forest(least_estimate(percent)), _EDGES)


def exact_edges(docs: DataFrame, nodes: DataFrame, groups_of: DataFrame, percent: int = PERCENT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b) of digests: for every two blocks of a candidate group a spanning forest of its exact links."""
    members = cut(nodes.select("digest", "doc_id", "n_shingles").join(groups_of, nodes["digest"] == groups_of["node"]).select("digest", "doc_id", "n_shingles", "label"))
    sizes = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("blocks"))
    sizes = cut(sizes.where("blocks > 1"))
    placed = members.join(sizes, "label", "left").select("digest", "doc_id", "label", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = placed.select(F.col("doc_id").alias("_d"), "digest", "label", "blocks", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("own"))
    others = F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE filter(sequence(0, blocks - 1), x -> x <> own) END")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(placed, F.col("doc_id") == F.col("_d"))
    spread = texts.select("digest", "text", "label", "own", F.explode(others).alias("other"))
    spread = spread.select("digest", "text", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return spread.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_confirm(percent), _EDGES)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; kept marks the smallest doc_id of a component."""
    all_rows = cut(sketches(docs))
    linkable = all_rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = cut(linkable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
    groups_of = components(candidate_edges(nodes, percent))
    labels = components(exact_edges(docs, nodes, groups_of, percent, block, block_shingles))
    named = nodes.select("digest", "doc_id").join(labels, F.col("digest") == F.col("node")).select("digest", "doc_id", "label")
    least = cut(named.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    linked = named.join(least, "label").select(F.col("digest").alias("_g"), "component_id")
    of = cut(nodes.select("digest", "doc_id").join(linked, F.col("digest") == F.col("_g"), "left").select(F.col("digest").alias("_g"), F.coalesce("component_id", "doc_id").alias("component_id")))
    out = all_rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(of, F.col("digest") == F.col("_g"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without those that have a smaller doc_id in their component; all columns stay. Rows with a null doc_id, or
    without words (null or empty text), are in no component and stay."""
    (gone,) = fresh(docs, "gone")
    out = near_duplicates(docs.select("doc_id", "text"), percent).where("NOT kept").select(F.col("doc_id").alias(gone))
    return docs.join(out, docs["doc_id"] == F.col(gone), "left_anti")
