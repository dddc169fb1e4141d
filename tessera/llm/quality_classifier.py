"""Quality classifier: naive Bayes support vectors.

A text becomes indicators of n-grams, hashed to 2^17 places: its words and word pairs in lower case, and one to three
in a row of its words' shapes (runs of capitals, small letters, digits and one mark, this with its length's magnitude, and whether a word repeats one of the
two before it). Each indicator is scaled by its class log-count ratio, counted over all labelled training rows, and the
vector brought to length 1. A linear hinge-loss model is fitted by dual coordinate descent on a bounded sample of the
training rows (`max_fit`, by a hash of doc_id), and its margins become probabilities by a logistic curve fitted on
margins of models that hadn't seen the row.

Learning takes only rows whose crc32(doc_id as text) mod 5 is not 0. A score's inputs are the text's n-grams alone.

Edge cases: null and empty texts have no n-grams and get the score of the bias. Null labels are left out, a doc_id with
several labels counts as its largest. A null doc_id is held out. Without labels of both classes every score is the
share of label 1 (one half without any).
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of

PLACES, FOLDS, THRESHOLD, MAX_FIT = 2**17, 5, 0.3, 3000
_BLOCK = 4096

_PARTS = re.compile(rb"([A-Z]+)|([a-z\x80-\xff]+)|([0-9]+)|(([^A-Za-z0-9\x80-\xff])\5*)")
_shapes: dict[bytes, int] = {}


def _shape(word: bytes) -> int:
    got = _shapes.get(word)
    if got is None:
        marks = [b"A" if m[1] else b"a" if m[2] else b"9" if m[3] else m[5] + b"%d" % len(m[4]).bit_length() for m in _PARTS.finditer(word)]
        got = xxhash.xxh3_64_intdigest(b"".join(marks)) >> 8
        if len(_shapes) >= 200_000:
            _shapes.clear()
        _shapes[word] = got
    return got


def places(text: bytes) -> np.ndarray:
    """Sorted distinct places of a whole text's n-grams."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), np.uint64, n)
    s = np.fromiter(map(_shape, words), np.uint64, n) << np.uint64(2)
    s[1:] += (h[1:] == h[:-1]).astype(np.uint64)
    s[2:] += (h[2:] == h[:-2]).astype(np.uint64) << np.uint64(1)
    s *= q
    grams = [h * p, (h[:-1] * p + h[1:]) * q, s, s[:-1] * p + s[1:] + np.uint64(1), (s[:-2] * p + s[1:-1]) * p + s[2:] + np.uint64(2) if n > 2 else s[:0]]
    return np.unique(np.concatenate([(g ^ (g >> np.uint64(29))) * p >> np.uint64(47) for g in grams])).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS == 0


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<i8")


def _count(sample_under: int):
    """Counts by class for blocks of places, and the sampled rows' places."""

    def run(batches):
        counts = np.zeros((2, PLACES), np.int64)
        n = [0, 0]
        kept = []
        for batch in batches:
            for text, y, u in zip(column_of(batch, "text", "binary"), column_of(batch, "quality"), column_of(batch, "u"), strict=True):
                x = places(text or b"")
                counts[y, x] += 1
                n[y] += 1
                if u < sample_under:
                    kept.append((y, u, x.astype("<i4").tobytes()))
        if sum(n):
            blocks = list(range(PLACES // _BLOCK))
            neg, pos = ([_packed(counts[c, b * _BLOCK : (b + 1) * _BLOCK]) for b in blocks] for c in (0, 1))
            yield _rows(blocks, [0] * len(blocks), [0] * len(blocks), neg, pos)
            yield _rows([-1], [n[0]], [n[1]], [_packed(np.zeros(0, np.int64))], [_packed(np.zeros(0, np.int64))])
        if kept:
            y, u, x = zip(*kept, strict=True)
            yield _rows([-2] * len(y), y, u, x, [b""] * len(y))

    return run


def _rows(block, n0, n1, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(n0, pa.int64()), pa.array(n1, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["block", "n0", "n1", "a", "b"])


def _sum_blocks(batches):
    held = {}
    for batch in batches:
        for block, n0, n1, a, b in zip(*(column_of(batch, c) for c in ("block", "n0", "n1", "a", "b")), strict=True):
            if block == -2:
                yield _rows([block], [n0], [n1], [a], [b])
                continue
            x = [np.array([n0, n1]), _unpacked(a), _unpacked(b)]
            held[block] = [p + q for p, q in zip(held[block], x, strict=True)] if block in held else x
    for block, (n, a, b) in held.items():
        yield _rows([block], [int(n[0])], [int(n[1])], [_packed(a)], [_packed(b)])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, rounds: int = 25, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of min 1/2 |w|^2 + sum cost_i * hinge(y_i * (w x_i + b)), y in {-1, 1}; the bias is a place of its own."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                bias += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> float:
        r = self.ratios[x]
        size = math.sqrt(float(r @ r))
        margin = float(self.weights[x] @ r) / size + self.bias if size else self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * margin + self.shift))))


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def learn(counts: np.ndarray, n: np.ndarray, sample: list[tuple[int, np.ndarray]], c: float = 1.0) -> Model:
    smooth = counts + 1.0
    ratios = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    y = np.array([1.0 if label else -1.0 for label, _ in sample])
    if len(set(y.tolist())) < 2:
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(np.zeros(PLACES), np.zeros(PLACES), 0.0, 1.0, math.log(share / (1 - share)))
    rows = [x for _, x in sample]
    values = []
    for x in rows:
        r = ratios[x]
        size = math.sqrt(float(r @ r))
        values.append(r / size if size else r)
    cost = c * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    fold = np.arange(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w, b = dual_coordinate_descent([rows[i] for i in train], [values[i] for i in train], y[train], PLACES, cost[train])
        margins[test] = [float(w[rows[i]] @ values[i]) + b for i in test]
    w, b = dual_coordinate_descent(rows, values, y, PLACES, cost)
    return Model(ratios, w, b, *_curve(margins, y))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Counts run over all labelled training rows; at most about max_fit of them, chosen by a hash, reach the driver."""
    y = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    y = y.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("quality"))
    fine = 1_000_000
    under = min(fine, -(-max_fit * fine // max(1, y.count())))
    train = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").hint("merge")  # one way at every size: labels grow with the documents
    train = train.join(y.hint("merge"), F.col("doc_id") == F.col("_id")).select("text", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(fine)).alias("u"))
    schema = "block int, n0 long, n1 long, a binary, b binary"
    found = train.mapInArrow(_count(under), schema).repartition(F.when(F.col("block") >= -1, F.col("block")).otherwise(F.pmod("n1", F.lit(64)) - 100)).mapInArrow(_sum_blocks, schema).collect()
    counts, n, sample = np.zeros((2, PLACES)), np.zeros(2), []
    for r in found:
        if r.block == -2:
            sample.append((r.n1, r.n0, np.frombuffer(r.a, "<i4").astype(np.int64)))
        elif r.block == -1:
            n += [r.n0, r.n1]
        else:
            counts[:, r.block * _BLOCK : (r.block + 1) * _BLOCK] += [_unpacked(r.a), _unpacked(r.b)]
    sample.sort(key=lambda s: (s[0], s[1], s[2].tobytes()))  # the same model from the same rows, however they came
    return learn(counts, n, [(label, x) for _, label, x in sample])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 x 2^17 numbers, whatever the corpus

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(places(t or b"")) for t in column_of(batch, "text", "binary")]
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
