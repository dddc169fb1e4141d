"""Points and the innermost interval around each, by a sweep over blocks of lines."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a file that are swept as one block, and the most and usual lines of a read.
BLOCK, MOST_LINES, USUAL_LINES = 4096, 500, 200

_FOUND = "path string, line_no int, id string"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, block, at, kind, end, size, id) in order: intervals (kind 0) enter a heap at their start; a point (kind 1)
    takes the smallest one that hasn't ended. An interval leaves when it is on top and has ended, so each enters and leaves once."""
    now, heap = None, []
    for batch in batches:
        out, cols = [], [c.to_pylist() for c in batch.columns]
        for path, block, at, kind, end, size, id_ in zip(*cols, strict=True):
            if (path, block) != now:
                now, heap = (path, block), []
            if kind == 0:
                heapq.heappush(heap, (size, id_, end))
                continue
            while heap and heap[0][2] < at:
                heapq.heappop(heap)
            if heap:
                out.append((path, at, heap[0][1]))
        cols = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "line_no", "id"])


def innermost(spans: DataFrame, points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, line_no, id) of distinct points (path, line_no): the shortest span (path, id, startLine, endLine) that holds
    each, ties to the least id; points within none are left out.

    A file is swept in blocks of lines, so a long one is many tasks. A span goes to the blocks that it reaches into; of
    those that cover a block whole only the shortest goes there.
    """
    b = F.lit(block)
    in_block = lambda c: F.floor(c / b).cast("long")
    s = spans.where("startLine <= endLine").select("path", "id", F.col("startLine").cast("int").alias("a"), F.col("endLine").cast("int").alias("z"))
    s = s.select("path", "id", "a", "z", (F.col("z") - F.col("a")).alias("size"), F.explode(F.sequence(in_block(F.col("a")), in_block(F.col("z")))).alias("block"))
    first, last = F.col("block") * b, F.col("block") * b + b - 1
    covers = (F.col("a") <= first) & (F.col("z") >= last)
    own = s.where(~covers).select("path", "block", F.greatest(F.col("a").cast("long"), first).cast("int").alias("at"), F.lit(0).alias("kind"), F.col("z").alias("end"), "size", "id")
    whole = s.where(covers).groupBy("path", "block").agg(F.min(F.struct("size", "id", "z")).alias("x"))
    whole = whole.select("path", "block", first.cast("int").alias("at"), F.lit(0).alias("kind"), F.col("x.z").alias("end"), F.col("x.size").alias("size"), F.col("x.id").alias("id"))
    p = points.select("path", F.col("line_no").cast("int").alias("at")).distinct()
    p = p.select("path", in_block(F.col("at")).alias("block"), "at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("id"))
    rows = own.unionAll(whole).unionAll(p).repartition("path", "block").sortWithinPartitions("path", "block", "at", "kind")
    return rows.mapInArrow(_sweep, _FOUND)


def read_lines(lines: DataFrame, spans: DataFrame, start: int = 1, count: int = USUAL_LINES) -> DataFrame:
    """(path, line_no, line, id) of lines (path, line_no, line) of files from a line on, MOST_LINES at most, each with the
    innermost span around it."""
    some = lines.where(F.col("line_no").between(start, start + max(0, min(count, MOST_LINES)) - 1))
    return some.join(innermost(spans, some), ["path", "line_no"], "left").select("path", "line_no", "line", "id")
