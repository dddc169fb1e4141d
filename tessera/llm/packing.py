"""Best-fit packing of token sequences, hierarchical: partitions pack, nearly full bins go out, the rest is merged.

A map task tokenises its documents, cuts only those over `capacity`, and packs its pieces by best fit decreasing. Bins
within `slack` of the capacity are done. Underfull bins go on as single items to a tree of rounds, each over fewer
partitions than the one before, where best fit joins them. Rounds end when one partition holds the rest, or when a
round joins almost nothing; no round puts more than about `items` bins into one task. Pieces then learn their final
sequence and offset from the (small) map of bins.

Edge cases: a null text is an empty one, whose only id is the end id 0, so each row gives at least one piece. Null or
repeated doc_ids are packed row by row. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, cut
from .tokens import encoder, tokenizer_path

CAPACITY, SLACK, ITEMS, FAN_IN = 2048, 8, 16_000, 8
#: Pieces that a map task packs at a time.
CHUNK = 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: each item's bin and offset, and each bin's fill.

    Bins wait in a stack for each room; an integer with one bit for each room that has bins finds the tightest fit.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            rooms[left].append(b)
            some |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _table(cols: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _local(path: str, end_id: int, capacity: int, remembered: tuple[int, int] | tuple[()]):
    names = [x.split()[0] for x in _PIECES.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def packed(rows: list[tuple], first: int):
        lengths = np.array([r[3] for r in rows], np.int64)
        bins, at, fill = best_fit(lengths, capacity)
        cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(5)]
        return _table([*cols, bins + first, at, fill[bins]], names, _TYPES), len(fill)

    def run(batches):
        encode = encoder(path, *remembered).encode
        first, rows = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc, ids in zip(column_of(part, "doc_id"), encode([x or b"" for x in column_of(part, "text", "binary")]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
                if len(rows) >= CHUNK:
                    out, n_bins = packed(rows, first)
                    yield out
                    first, rows = first + n_bins, []
        yield packed(rows, first)[0]

    return run


def _merge(capacity: int):
    """Joins bins, as items: (bin, into, shift, fill of into)."""

    def run(batches):
        bins, fills = [], []
        for batch in batches:
            bins.append(np.asarray(batch.column(0)))
            fills.append(np.asarray(batch.column(1)))
        bins, fills = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (bins, fills))
        order = np.argsort(bins, kind="stable")
        bins, fills = bins[order], fills[order]
        into, shift, fill = best_fit(fills, capacity)
        head = np.empty(len(fill), np.int64)  # a joined bin is named by the item at its start
        head[into[shift == 0]] = bins[shift == 0]
        yield _table([bins, head[into], shift, fill[into]], ["bin", "into", "shift", "fill"], [pa.int64()] * 4)

    return run


def pieces_of(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, remembered: tuple[int, int] | tuple[()] = ()) -> DataFrame:
    """Pieces with their place in the bins of their own partition."""
    path = tokenizer or tokenizer_path()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_local(path, end_id, capacity, remembered), _PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, slack: int = SLACK, items: int = ITEMS, remembered: tuple[int, int] | tuple[()] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of every document. remembered: how many
    words and stems a worker keeps the ids of, which takes memory and saves time."""
    pieces = cut(pieces_of(docs, tokenizer, end_id, capacity, remembered))
    rest = pieces.where((F.col("at") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill")
    left = rest.count()
    width, where = None, None
    while left > 1:
        width = max(1, -(-left // items)) if width is None else max(1, -(-left // items), -(-width // FAN_IN))
        joined = cut(rest.repartition(width, F.xxhash64("bin", F.lit(left))).mapInArrow(_merge(capacity), "bin long, into long, shift long, fill long"))
        step = joined.select("bin", "into", "shift")
        if where is None:
            where = step
        else:
            then = step.select(F.col("bin").alias("_b"), F.col("into").alias("_i"), F.col("shift").alias("_s"))
            where = where.join(then, F.col("into") == F.col("_b"), "left").select("bin", F.coalesce("_i", "into").alias("into"), (F.col("shift") + F.coalesce("_s", F.lit(0))).alias("shift"))
        rest = joined.where((F.col("shift") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill")
        before, left = left, rest.count()
        if width == 1 or left > 0.98 * before:
            break
    if where is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    where = where.where("bin <> into").select(F.col("bin").alias("_b"), "into", "shift")
    placed = pieces.join(where, F.col("bin") == F.col("_b"), "left")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
