"""Shortest paths and cycles themselves, by frontiers that keep the least path to each of their nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Keys of meeting paths that are broadcast at most.
MOST_KEYS = 2_000_000


def _start(pairs: DataFrame, end: str) -> DataFrame:
    return cut(pairs.select(F.col(end).alias("seed")).distinct().select("seed", F.col("seed").alias("id"), F.array("seed").alias("path")))


def _step(frontier: DataFrame, moves: DataFrame, seen: DataFrame, back: bool) -> DataFrame:
    """The frontier one move on (or back): nodes that weren't seen, each with its least path."""
    here, there = ("dst", "src") if back else ("src", "dst")
    one = F.array(there)
    path = F.concat(one, "path") if back else F.concat("path", one)
    step = frontier.join(moves, frontier["id"] == moves[here]).select("seed", F.col(there).alias("id"), path.alias("path"))
    least = step.groupBy("seed", "id").agg(F.min("path").alias("path"))
    return cut(least.join(seen, ["seed", "id"], "left_anti"))


def shortest_paths(moves: DataFrame, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """(a, b, length, path) of pairs (a, b) that at most max_depth moves (src, dst) connect: of all shortest paths the least.

    Frontiers go out from both ends in turn and meet, so each goes half the depth. All shortest paths of length n cross the
    frontier from a at ceil(n / 2) moves, where the least one of either side is known. Pairs that have met send out no more.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    moves = cut(moves.select("src", "dst").distinct().repartition("src"))
    found = pairs.where("a = b").select("a", "b", F.lit(0).alias("length"), F.array("a").alias("path"))
    open_ = cut(pairs.where("a <> b"))
    sides = {False: _start(open_, "a"), True: _start(open_, "b")}
    seen = {side: front.select("seed", "id") for side, front in sides.items()}
    for length in range(1, max_depth + 1):
        back = length % 2 == 0
        ends = open_.select(F.col("b" if back else "a").alias("seed")).distinct()
        front = _step(sides[back].join(ends, "seed", "left_semi"), moves, seen[back], back)
        sides[back], seen[back] = front, cut(seen[back].unionByName(front.select("seed", "id")))
        from_a = sides[False].select(F.col("seed").alias("a"), "id", F.col("path").alias("head"))
        from_b = sides[True].select(F.col("seed").alias("b"), "id", F.col("path").alias("tail"))
        whole = F.concat("head", F.slice("tail", F.lit(2), F.greatest(F.size("tail") - 1, F.lit(0))))
        met = open_.join(from_a, "a").join(from_b, ["b", "id"]).groupBy("a", "b").agg(F.min(whole).alias("path"))
        met = cut(met.select("a", "b", F.lit(length).alias("length"), "path"))
        found = found.unionByName(met)
        open_ = cut(open_.join(met, ["a", "b"], "left_anti"))
        if open_.isEmpty() or front.isEmpty():
            break
    return found


def _held(front: DataFrame, keys: DataFrame) -> DataFrame:
    """The least path to each node of a frontier, of those whose keys are named."""
    rows = front.withColumn("k", F.xxhash64("start", "id")).join(keys, "k", "left_semi")
    return rows.groupBy("start", "id").agg(F.min("path").alias("path"))


def _closed(front: DataFrame, back: DataFrame, length: int) -> DataFrame:
    """(least, length, cycle) where a start's two frontiers meet. Paths stay where they are until a hash of start and node tells
    which can meet: only that is shuffled for all of them."""
    key = lambda side: side.select(F.xxhash64("start", "id").alias("k"))
    keys = cut(key(front).join(key(back), "k", "left_semi").distinct())
    keys = F.broadcast(keys) if keys.count() <= MOST_KEYS else keys
    tails = _held(back, keys).withColumnRenamed("path", "tail")
    whole = F.concat("path", F.slice("tail", F.lit(2), F.size("tail")))
    met = _held(front, keys).join(tails, ["start", "id"]).groupBy(F.col("start").alias("least")).agg(F.min(whole).alias("cycle"))
    return cut(met.select("least", F.lit(length).alias("length"), "cycle"))


def cycles(moves: DataFrame, max_length: int = 10, members: DataFrame | None = None) -> DataFrame:
    """(least, length, cycle): for each node that is the least of a cycle of moves (src, dst), a shortest cycle of at most
    max_length moves whose other nodes are all greater, and of these the least one; each set of members once.

    Frontiers (start, node) go out through greater nodes along the moves and against them in turn, and meet, so each goes half the
    length. The last step of either isn't stored but made again where it is read. members (id, component), if given, are
    strongly connected components: moves between them are on no cycle.
    """
    m = moves.where("src <> dst").select("src", "dst").distinct()
    if members is not None:
        a, b = (members.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in ("src", "dst"))
        m = m.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst")
    m = cut(m.repartition("src"))
    ends = {False: m, True: cut(m.repartition("dst"))}
    sides = {
        False: m.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("id"), F.array("src", "dst").alias("path")),
        True: ends[True].where("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("id"), F.array("src").alias("path")),
    }
    found = _closed(sides[False], sides[True], 2) if max_length >= 2 else sides[False].limit(0).select(F.col("start").alias("least"), F.lit(0).alias("length"), F.col("path").alias("cycle"))
    for length in range(3, max_length + 1):
        back = length % 2 == 0
        side = sides[back]
        if length > 4:  # what goes further is stored, without starts that are done
            side = side.join(found.select(F.col("least").alias("start")), "start", "left_anti")
            side = cut(side.groupBy("start", "id").agg(F.min("path").alias("path")))
            if side.isEmpty():
                break
        here, there = ("dst", "src") if back else ("src", "dst")
        path = F.concat(F.array(there), "path") if back else F.concat("path", F.array(there))
        sides[back] = side.join(ends[back], side["id"] == ends[back][here]).where(F.col(there) > F.col("start")).select("start", F.col(there).alias("id"), path.alias("path"))
        found = found.unionByName(_closed(sides[False], sides[True], length))
    first = found.groupBy("least").agg(F.min("length").alias("length"), F.min_by("cycle", "length").alias("cycle"))
    once = Window.partitionBy(F.array_sort("cycle")).orderBy("cycle")
    return first.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
