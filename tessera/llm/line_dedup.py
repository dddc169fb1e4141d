"""Line deduplication by range-partitioned line hashes and per-document keep bitmaps.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of at least `min_chars`
code points that are found in at least `min_docs` documents lose all their lines except in the document of the
largest doc_id.

Each map task first settles what it can alone: where it sees `min_docs` documents or more with one key, all but its
largest one certainly lose their lines, so only that one goes on, marked as standing for enough documents. A key thus
sends at most `min_docs - 1` rows a task into the shuffle, however hot it is. The rows then go to ranges of the
(uniform) 128-bit hash, are sorted by hash and document, and one pass with constant state streams them. What comes
back are compressed bitmaps by document, not text; documents join them once.

Edge cases: null text is one empty line and has nothing to drop. Rows with a null doc_id keep all their lines and
count for no key. Rows that repeat a doc_id count as one document; a bitmap is bound to doc_id and a hash of the text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, fresh, partitions, slices

MIN_CHARS, MIN_DOCS = 20, 3
#: Lines that a map task holds before it settles them.
CHUNK_LINES = 400_000

_LINES = "decided boolean, h1 long, h2 long, doc_id long, tk long, n_lines int, enough boolean, pos binary"
_DROPS = "doc_id long, tk long, n_lines int, pos binary"
_MAPS = "doc_id long, tk long, n_lines int, n_dropped int, keep_bitmap binary"
_INT32 = np.dtype("<i4")


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _long(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def keys_of(text: bytes, min_chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """The number of lines, and each long enough key's positions."""
    lines, keys = text.split(b"\n"), {}
    for i, line in enumerate(lines):
        key = line.strip().lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            keys.setdefault(key, []).append(i)
    return len(lines), keys


def _local(min_chars: int, min_docs: int, chunk: int):
    names = [x.split()[0] for x in _LINES.split(", ")]
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def settle(held: dict[bytes, list[tuple]]):
        rows = []
        for digest, found in held.items():
            h1, h2 = _long(digest[:8]), _long(digest[8:])
            docs = {x[0] for x in found}
            enough = len(docs) >= min_docs
            last = max(docs)
            rows += [(enough and doc != last, h1, h2, doc, tk, n, enough, pos) for doc, tk, n, pos in found]
            if len(rows) >= 50_000:
                yield _batch(rows, names, types)
                rows = []
        yield _batch(rows, names, types)

    def run(batches):
        held, n_held = {}, 0
        for batch in slices(batches):
            for doc, text, tk in zip(column_of(batch, "doc_id"), column_of(batch, "text", "binary"), column_of(batch, "tk"), strict=True):
                n, keys = keys_of(text, min_chars)
                for key, pos in keys.items():
                    held.setdefault(xxhash.xxh3_128_digest(key), []).append((doc, tk, n, np.array(pos, _INT32).tobytes()))
                n_held += len(keys)
                if n_held >= chunk:
                    yield from settle(held)
                    held, n_held = {}, 0
        yield from settle(held)

    return run


def _stream(min_docs: int):
    names = [x.split()[0] for x in _DROPS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        key, keeper, docs, enough, waiting, last = None, None, 0, False, [], None
        for batch in batches:
            rows = []
            cols = [column_of(batch, c) for c in ("decided", "h1", "h2", "doc_id", "tk", "n_lines", "enough", "pos")]
            for decided, h1, h2, doc, tk, n, many, pos in zip(*cols, strict=True):
                if decided:
                    rows.append((doc, tk, n, pos))
                    continue
                if (h1, h2) != key:
                    key, keeper, docs, enough, waiting, last = (h1, h2), doc, 0, False, [], None
                docs += doc != last
                last = doc
                enough = enough or many or docs >= min_docs
                if doc != keeper:
                    waiting.append((doc, tk, n, pos))  # at most min_docs - 2 documents wait
                if enough and waiting:
                    rows += waiting
                    waiting = []
            yield _batch(rows, names, types)

    return run


def _bitmaps(batches):
    names = [x.split()[0] for x in _MAPS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        rows = []
        for doc, tk, n, pos in zip(*(column_of(batch, c) for c in ("doc_id", "tk", "n_lines", "pos")), strict=True):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(pos), _INT32)] = False
            rows.append((doc, tk, n, int(n - keep.sum()), zlib.compress(np.packbits(keep).tobytes())))
        yield _batch(rows, names, types)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(doc_id, tk, n_lines, n_dropped, keep_bitmap) of each document that loses lines; tk is xxhash64 of its text."""
    n = partitions(docs.sparkSession)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tk"))
    lines = texts.mapInArrow(_local(min_chars, min_docs, chunk_lines), _LINES)
    by_range = F.least(F.floor((F.col("h1") / F.lit(2.0**64) + 0.5) * n).cast("int"), F.lit(n - 1))
    spread = F.pmod(F.xxhash64("doc_id", "h1"), F.lit(n)).cast("int")
    ranged = lines.repartitionById(n, F.when(F.col("decided"), spread).otherwise(by_range))
    drops = ranged.sortWithinPartitions("decided", "h1", "h2", F.desc("doc_id"), "tk").mapInArrow(_stream(min_docs), _DROPS)
    grouped = drops.groupBy("doc_id", "tk").agg(F.first("n_lines").alias("n_lines"), F.collect_list("pos").alias("pos"))
    return grouped.mapInArrow(_bitmaps, _MAPS)


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Lines before dropping, lines dropped, and the text that stays."""
    if bitmap is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    left = [x for x, k in zip(lines, keep, strict=True) if k]
    return len(lines), len(lines) - len(left), b"\n".join(left)


def _with_bitmaps(docs: DataFrame, **options) -> tuple[DataFrame, str, str]:
    tk, bitmap = fresh(docs, "tk", "keep_bitmap")
    maps = keep_bitmaps(docs, **options).select(F.col("doc_id").alias("_m"), F.col("tk").alias("_t"), F.col("keep_bitmap").alias("_b"))
    left = docs.select("*", F.xxhash64("text").alias(tk))
    left = left.select(F.struct(*docs.columns).alias("d"), F.col("doc_id").cast("long").alias("_i"), F.col(tk).alias("_k"))
    joined = left.join(maps, (F.col("_i") == F.col("_m")) & (F.col("_k") == F.col("_t")), "left")
    return joined.select("d.*", F.col("_b").alias(bitmap)), tk, bitmap


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated lines gone from text (and n_chars, if there, counted anew); all columns stay.

    A document of which no line is left stays with an empty text. Null texts stay null; rows with a null doc_id keep all
    their lines.
    """
    joined, _, bitmap = _with_bitmaps(docs, **options)
    at, columns = joined.columns.index("text"), docs.columns

    def run(batches):
        for batch in slices(batches):
            maps = column_of(batch, bitmap)
            if any(m is not None for m in maps):
                texts = column_of(batch, "text", "binary")
                new = [x if m is None else kept_lines(x, m)[2] for x, m in zip(texts, maps, strict=True)]
                batch = batch.set_column(at, "text", pa.array(new, pa.binary()).cast(batch.schema.field(at).type))
            yield batch.select(columns)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row of docs."""
    joined, _, bitmap = _with_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc, text, m in zip(column_of(batch, "doc_id"), column_of(batch, "text", "binary"), column_of(batch, bitmap), strict=True):
                n, dropped, left = kept_lines(text or b"", m)
                rows.append((doc, n, dropped, hashlib.sha256(left).hexdigest()))
            yield _batch(rows, ["doc_id", "n_lines", "n_dropped", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
