"""Mixing sources to target weights: hierarchical budgets and seeded epochs, in DataFrame functions only.

Documents are leaves' members in a tree of columns (domain, language, source). A budget of tokens flows down by weight.
Among siblings it is shared like water: who can't take its share (its subtree holds fewer tokens, all epochs counted)
is filled, and the shortage goes to its siblings by weight. As a subtree never gets more than it can hold, a shortage
is met among siblings before it reaches their parent's siblings.

A leaf's budget buys whole epochs first and then the longest token-prefix of one more epoch, whose order is the hash
of seed, epoch and doc_id. The prefix's end is found by digit: tokens are summed by the hash's first two hex digits
(256 sums a leaf), the bucket in which the budget ends is split by the next two, and so on until it holds few rows;
only those are put in order. No task ever sorts a leaf, however hot its source is.

Edge cases: null texts have no tokens; null keys are a leaf value of their own; rows that share a doc_id (null counts
as one) within a leaf share their place, so they are taken together or not at all. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, fresh

#: Rows of a boundary bucket that are put in order.
FEW = 200
#: Leaves whose cut-offs may be broadcast (about 100 bytes each).
MOST_BROADCAST = 50_000


def word_tokens(text: Column) -> Column:
    """Tokens of a text: its words."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number's remainder by 4."""
    return F.concat(F.lit("domain"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("int") % 4)


def weight_of(value: Column, weights: dict[str, int], default: int = 1) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(value == name, w).otherwise(out)
    return F.coalesce(out, F.lit(default)).cast("long")


def share(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Adds `budget` to siblings with `weight` and `cap`, of which `_b` is their parent's budget."""
    big = lambda c: F.col(c).cast("decimal(20,0)")
    siblings = Window.partitionBy(*parent)
    by_need = siblings.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))), *order)
    n = nodes.withColumn("_before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    n = n.withColumn("_w", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
    n = n.withColumn("_full", (F.col("weight") > 0) & (big("cap") * big("_w") <= (big("_b") - big("_before")) * big("weight")))
    n = n.withColumn("_left", F.col("_b") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(siblings), F.lit(0)))
    n = n.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(siblings))
    part = F.when(F.col("_open") > 0, F.floor(F.col("_left").cast("decimal(20,0)") * big("weight") / big("_open"))).otherwise(0)
    return n.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.least(part.cast("long"), F.col("cap")))).drop("_before", "_w", "_full", "_left", "_open", "_b")


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], total: int, max_epochs: int) -> DataFrame:
    """leaves (levels, supply) with each leaf's budget of tokens."""
    sized = leaves.withColumn("cap", (F.col("supply") * max_epochs).cast("long"))
    above = None
    for depth in range(1, len(levels) + 1):
        keys, parent = levels[:depth], levels[: depth - 1]
        nodes = sized.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.col(keys[-1]), weights[depth - 1]))
        if above is None:
            nodes = nodes.withColumn("_b", F.lit(total).cast("long"))
        else:
            up = above.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(parent)), F.col("budget").alias("_b"))
            same = F.lit(True)
            for i, k in enumerate(parent):
                same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
            nodes = nodes.join(up, same).select(*keys, "cap", "weight", "_b")
        above = share(nodes, parent, keys[-1:])
    return above.select(*levels, "budget")


def place(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A document's place in an epoch's order, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def plan(docs: DataFrame, levels: list[Column], weights: list[dict[str, int]], share_of_supply: tuple[int, int], max_epochs: int, seed: int, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, g0.., tokens, leaf) without texts, and each leaf's (leaf, epochs, last): whole epochs, and the last place of the next one ('' if none)."""
    names = [f"g{i}" for i in range(len(levels))]
    slim = docs.select("doc_id", *(c.cast("string").alias(n) for c, n in zip(levels, names, strict=True)), word_tokens(F.col("text")).alias("tokens"))
    slim = cut(slim.withColumn("leaf", F.to_json(F.array(*names))))
    leaves = slim.groupBy("leaf").agg(F.sum("tokens").alias("supply"), *(F.first(n).alias(n) for n in names))
    leaves = cut(leaves)
    supply = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0]
    part = budgets(leaves, names, weights, supply * share_of_supply[0] // share_of_supply[1], max_epochs)
    same = F.lit(True)
    for n in names:
        same = same & leaves[n].eqNullSafe(part[n])
    part = leaves.join(part, same).select("leaf", "supply", "budget")
    part = part.withColumn("epochs", F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(F.lit(min(1, share_of_supply[0]))).cast("int"))
    part = cut(part.withColumn("room", F.col("budget") - F.col("epochs") * F.col("supply")))
    asked = part.where("room > 0").select("leaf", "epochs", "room")
    few_leaves = asked.count() <= MOST_BROADCAST
    hint = F.broadcast if few_leaves else lambda x: x
    rows = slim.join(hint(asked), "leaf").select("leaf", "room", "tokens", place(F.col("doc_id"), F.col("epochs"), seed).alias("at"))
    rows = cut(rows)
    edge = asked.select("leaf", F.lit("").alias("prefix"), F.col("room"))
    digits = 0
    while True:
        digits += 2
        inside = rows.drop("room").join(hint(edge), "leaf").where(F.col("at").startswith(F.col("prefix")))
        sums = inside.groupBy("leaf", F.substring("at", 1, digits).alias("bucket")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.first("room").alias("room"))
        upto = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = sums.withColumn("s", F.sum("t").over(upto)).where("s > room")
        edge = cut(over.groupBy("leaf").agg(F.min_by(F.struct(F.col("bucket").alias("prefix"), (F.col("room") - F.col("s") + F.col("t")).alias("room"), "n"), "bucket").alias("x")).select("leaf", "x.*"))
        if digits >= 30 or (edge.agg(F.max("n")).first()[0] or 0) <= few:
            break
    inside = rows.drop("room").join(hint(edge.drop("n")), "leaf").where(F.col("at").startswith(F.col("prefix")))
    upto = Window.partitionBy("leaf").orderBy("at")  # rows in one place go together
    last = inside.withColumn("s", F.sum("tokens").over(upto)).where("s <= room").groupBy("leaf").agg(F.max("at").alias("inner"))
    ends = edge.join(last, "leaf", "left").select("leaf", F.coalesce("inner", "prefix").alias("last"))  # all before the bucket are in
    found = part.join(ends, "leaf", "left").select("leaf", "epochs", F.when(F.col("room") > 0, F.coalesce("last", F.lit("g"))).otherwise("").alias("last"))
    return slim, cut(found)


def _taken(rows: DataFrame, ends: DataFrame, leaf: str, doc_id: str, seed: int, epoch: str) -> DataFrame:
    small = ends.count() <= MOST_BROADCAST
    e_leaf, e_epochs, e_last = fresh(rows, "e_leaf", "e_epochs", "e_last")
    e = ends.select(F.col("leaf").alias(e_leaf), F.col("epochs").alias(e_epochs), F.col("last").alias(e_last))
    joined = rows.join(F.broadcast(e) if small else e, F.col(leaf) == F.col(e_leaf))
    partial = (F.col(e_last) != "") & (place(F.col(doc_id), F.col(e_epochs), seed) <= F.col(e_last))
    n = F.col(e_epochs) + partial.cast("int")
    return joined.where(n > 0).select(*(F.col(c) for c in rows.columns), F.explode(F.sequence(F.lit(0), n - 1)).alias(epoch))


def mix(docs: DataFrame, levels: list[Column], weights: list[dict[str, int]], share_of_supply: tuple[int, int] = (3, 5), max_epochs: int = 2, seed: int = 7, few: int = FEW) -> DataFrame:
    """(doc_id, g0, g1, .., tokens, epoch): a row for each time that a document is taken."""
    slim, ends = plan(docs, levels, weights, share_of_supply, max_epochs, seed, few)
    return _taken(slim, ends, "leaf", "doc_id", seed, "epoch").drop("leaf")


def mix_documents(docs: DataFrame, levels: list[Column], weights: list[dict[str, int]], share_of_supply: tuple[int, int] = (4, 5), max_epochs: int = 1, seed: int = 7) -> DataFrame:
    """The documents taken, all columns as they were; a document comes once for each epoch that takes it. No text is shuffled."""
    _, ends = plan(docs, levels, weights, share_of_supply, max_epochs, seed)
    leaf, epoch = fresh(docs, "leaf", "epoch")
    rows = docs.withColumn(leaf, F.to_json(F.array(*(c.cast("string") for c in levels))))
    return _taken(rows, ends, leaf, "doc_id", seed, epoch).select(*docs.columns)
