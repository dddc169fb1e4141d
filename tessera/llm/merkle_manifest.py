"""Merkle manifest of a table: a tree of digests for each group, the groups' roots in a tree of their own.

Upper-tree variant. Leaves get their places by a range sort of digests, texts don't travel. A distributed reduction folds
large blocks of consecutive leaves (ARITY ** LEVELS) into one node each, round after round, until few nodes (TOP) are left:
the small top tree. The driver builds that, and broadcasts the path that each of its nodes has to the root. Executors
then finish the proofs and fold every row up to the root, block by block.

H is the lower-case hex SHA-256 of its inputs, one after the other. While a tree has several nodes, every ARITY
consecutive ones become their H; the last run may have fewer, even one.

Edge cases: null fields are written as `-`, null groups are a group of their own that comes first. Rows of one group
with equal (or null) order keys go by their digests, nulls first; equal rows are leaves each. A row without an order key
is never tampered with. A lone leaf is its group's root, a lone group's root is the root. An empty table gives no rows.
Only named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .near_dedup import groups

ARITY, LEVELS, TOP = 8, 4, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "tree string, pos long, n long, digest string"
_PATHS = "tree string, block long, subroot string, path string"
_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def h(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def digest_of(fields: list[Column]) -> Column:
    """H of the fields: `-` for null, else UTF-8 byte count, `:`, value."""
    written = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for c in fields for s in (c.cast("string"),)]
    return F.sha2(F.concat(*written).cast("binary"), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, doc_id, digest, changed): each row's leaf, and its digest with the fields of `tampered` in their place where
    the condition holds."""
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    other = digest_of([(tampered or {}).get(f, F.col(f)) for f in fields])
    changed = F.when(where, other) if tampered and where is not None else F.lit(None).cast("string")
    return docs.select(tree.alias("tree"), F.col(order).cast("long").alias("doc_id"), digest_of([F.col(f) for f in fields]).alias("digest"), changed.alias("changed"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their place in their tree (pos, from 0) and the tree's number of rows (n). They are sorted by ranges; a
    row's number within its range, and the rows that its tree has in the ranges before, give the place."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    ranged = cut(ranged).withColumn("part", F.shiftright("at", 33))
    of_tree = Window.partitionBy("tree")
    runs = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(of_tree).alias("n"))
    return ranged.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def layers_of(nodes: list[str], n: int, levels: int) -> list[list[str]]:
    """A block's nodes and the layers above them: up to the root of a tree that the block holds whole, else `levels`."""
    out, whole = [nodes], n <= ARITY**levels
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        out.append([h(out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def paths_of(layers: list[list[str]], rest: str, lowest: int = 0) -> list[str]:
    """The path of each node of the layer `lowest`: for each level its place in its run, `:` and its siblings, `;` after."""
    above = [rest]
    for nodes in reversed(layers[lowest:-1]):
        runs = [nodes[i : i + ARITY] for i in range(0, len(nodes), ARITY)]
        above = [f"{k}:{''.join(run[:k] + run[k + 1 :])};{above[r]}" for r, run in enumerate(runs) for k in range(len(run))]
    return above


def steps_of(path: str) -> list[tuple[str, str]]:
    """The siblings to the left and to the right, level by level."""
    out = []
    for level in path.split(";")[:-1]:
        k, siblings = level.split(":")
        out.append((siblings[: 64 * int(k)], siblings[64 * int(k) :]))
    return out


def folded(node: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        node = h([left, node, right])
    return node


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], [name for name, _ in fields])


def _blocks(batches, levels: int, columns: list[str]) -> Iterator[tuple]:
    """(tree, block, n, rows) of rows that lie block by block."""
    for (tree, block, n), rows in groups(batches, ["tree", "block", "n"], columns):
        yield tree, block, n, rows


def _roots(levels: int):
    def run(batches):
        done = []
        for tree, block, n, rows in _blocks(batches, levels, ["digest"]):
            layers = layers_of([r[0] for r in rows], n, levels)
            done.append((tree, block, -(-n // ARITY**levels), layers[-1][0]))
        yield _batch(done, _NODES)

    return run


def _lower_paths(levels: int):
    """Paths of a round's nodes, from those of its blocks."""

    def run(batches):
        for tree, block, n, rows in _blocks(batches, levels, ["digest", "pos", "subroot", "path"]):
            layers = layers_of([r[0] for r in rows], n, levels)
            paths = paths_of(layers, rows[0][3])
            yield _batch([(tree, r[1], rows[0][2], p) for r, p in zip(rows, paths, strict=True)], _PATHS)

    return run


def _proved(levels: int, root: str):
    """Proofs and folds of a block's leaves. What lies above a run of leaves is parsed once for all of them."""

    def run(batches):
        for _, _, n, rows in _blocks(batches, levels, ["doc_id", "digest", "changed", "subroot", "path"]):
            layers = layers_of([r[1] for r in rows], n, levels)
            subroot, out = rows[0][3], []
            if len(layers) == 1:
                above = [steps_of(rows[0][4])]
            else:
                above = [steps_of(p) for p in paths_of(layers, rows[0][4], 1)]
            joined = ["".join(left + right for left, right in steps) for steps in above]
            for j, (doc_id, leaf, changed, _, _) in enumerate(rows):
                r = j // ARITY
                start = leaf if changed is None else changed
                if len(layers) == 1:
                    proof, fold = joined[0], folded(start, above[0])
                else:
                    run_ = layers[0][r * ARITY : (r + 1) * ARITY]
                    left, right = "".join(run_[: j % ARITY]), "".join(run_[j % ARITY + 1 :])
                    proof, fold = left + right + joined[r], folded(h([left, start, right]), above[r])
                out.append((doc_id, leaf, subroot, root, h([proof]), fold))
            yield _batch(out, _PROVED)

    return run


def reduced(nodes: DataFrame, levels: int = LEVELS, top: int = TOP) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' nodes, dealt and sorted by block, and the nodes that are left: `top` at most, or one of each tree."""
    rounds = []
    while True:
        dealt = nodes.withColumn("block", F.floor(F.col("pos") / ARITY**levels).cast("long"))
        dealt = cut(dealt.repartition("tree", "block").sortWithinPartitions("tree", "pos"))
        rounds.append(dealt)
        nodes = cut(dealt.mapInArrow(_roots(levels), _NODES))
        if nodes.count() <= top or nodes.where("n > 1").isEmpty():
            return rounds, nodes


def _top_paths(spark: SparkSession, nodes: DataFrame) -> tuple[DataFrame, str]:
    """The top tree, built on the driver from its few nodes: their paths, and the root."""
    trees: dict[str, list[tuple[int, str]]] = {}
    for r in nodes.collect():
        trees.setdefault(r.tree, []).append((r.pos, r.digest))
    names = sorted(trees, key=str.encode)
    inner = {t: layers_of([d for _, d in sorted(trees[t])], 0, 1) for t in names}
    outer = layers_of([inner[t][-1][0] for t in names], 0, 1)
    rest = paths_of(outer, "")
    paths = [(t, k, inner[t][-1][0], p) for t, up in zip(names, rest, strict=bool(names)) for k, p in enumerate(paths_of(inner[t], up))]
    return spark.createDataFrame(paths, _PATHS), outer[-1][0] if names else ""


def _with_paths(dealt: DataFrame, paths: DataFrame, few: bool, levels: int) -> DataFrame:
    """Rows of blocks, the first row of each with its block's path. Few paths are broadcast; others are joined, and the
    rows dealt and sorted anew."""
    first = F.when(F.col("pos") % ARITY**levels == 0, F.col("block")).otherwise(-1 - F.col("pos"))
    rows = dealt.withColumn("own", F.col("block")).withColumn("block", first)
    if few:
        return rows.join(F.broadcast(paths), ["tree", "block"], "left").drop("block").withColumnRenamed("own", "block")
    rows = rows.join(paths, ["tree", "block"], "left").drop("block").withColumnRenamed("own", "block")
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "pos")


def tree_paths(spark: SparkSession, nodes: DataFrame, levels: int = LEVELS, top: int = TOP) -> tuple[list[DataFrame], DataFrame, str, bool]:
    """The rounds over nodes (tree, pos, n, digest, ..), the paths of the first round's blocks, the root, and whether the
    paths are few."""
    rounds, left = reduced(nodes, levels, top)
    if few := left.count() <= top:
        paths, root = _top_paths(spark, left)
    else:  # one node of each of many trees: they are the leaves of one tree
        names = left.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        upper, above, root, few = tree_paths(spark, placed(names, "name"), levels, top)
        up = _with_paths(upper[0], above, few, levels).mapInArrow(_lower_paths(levels), _PATHS).withColumnRenamed("block", "pos")
        named = upper[0].select("name", "pos", "digest").join(up.select("pos", "path"), "pos")
        paths, few = cut(named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "path")), False
    for dealt in reversed(rounds[1:]):
        paths, few = cut(_with_paths(dealt, paths, few, levels).mapInArrow(_lower_paths(levels), _PATHS)), False
    return rounds, paths, root, few


def prove(found: DataFrame, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each of leaves(): the digest of its siblings up
    to the root, and what its tampered digest (else its own) folds to with them."""
    rows = placed(cut(found), "doc_id", "digest")
    rounds, paths, root, few = tree_paths(found.sparkSession, rows, levels, top)
    out = _with_paths(rounds[0], paths, few, levels).mapInArrow(_proved(levels, root), _PROVED)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampering() -> tuple[dict[str, Column], Column]:
    """Where 3 divides the CRC-32 of the decimal doc_id, A-Z of the text become a-z."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"text": lower}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
