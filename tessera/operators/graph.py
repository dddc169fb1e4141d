"""Graph operators over nodes(id, ...) and edges(sourceId, targetId, type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import DEFAULT_EDGE_WEIGHT, DEPENDENCY_TYPES, EDGE_WEIGHTS
from tessera.session import cut


#: Levels of a search after which what it has seen is written as one table, so that plans stay short.
MERGED = 16


def of_types(edges: DataFrame, types) -> DataFrame:
    return edges.where(F.col("type").isin(*types))


def callers(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    hit = edges.where((F.col("targetId") == node_id) & (F.col("type") == "calls")).select(F.col("sourceId").alias("id"))
    return nodes.join(hit, "id")


def callees(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    hit = edges.where((F.col("sourceId") == node_id) & (F.col("type") == "calls")).select(F.col("targetId").alias("id"))
    return nodes.join(hit, "id")


def _ways(edges: DataFrame, types, reverse: bool = False) -> DataFrame:
    """arcs, with repeats where edges of several types or rows are alike."""
    a, b = ("targetId", "sourceId") if reverse else ("sourceId", "targetId")
    return of_types(edges, types).select(F.col(a).alias("src"), F.col(b).alias("dst"))


def arcs(edges: DataFrame, types, reverse: bool = False) -> DataFrame:
    """(src, dst) along the edges of some types, or against them."""
    return _ways(edges, types, reverse).distinct()


def down(edges: DataFrame) -> DataFrame:
    """contains along, inherits and implements against; what walks them drops repeats."""
    return _ways(edges, ["contains"]).union(_ways(edges, ["inherits", "implements"], reverse=True))


def up(edges: DataFrame) -> DataFrame:
    return _ways(edges, ["contains"], reverse=True).union(_ways(edges, ["inherits", "implements"]))


def reach(moves: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, id, depth) of all nodes within max_depth moves (src, dst) of each seed (id), at their least depth.

    A frontier goes out one move at a time; nodes seen before are dropped by an anti-join, so cycles end. The moves are made
    once, dealt by their source, where repeats are dropped, so that a step shuffles its frontier only.
    """
    if max_depth > 1:
        moves = cut(moves.repartition("src").distinct())
    seen = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(moves, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % MERGED == 0:
            seen = cut(seen.repartition("seed", "id"))
    return seen


def descendants(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    return reach(down(edges), seeds, max_depth).where("depth > 0")


def ancestors(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    return reach(up(edges), seeds, max_depth).where("depth > 0")


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, types=DEPENDENCY_TYPES) -> DataFrame:
    """What depends on the seeds, against the dependency edges; a seed isn't in its own radius."""
    return reach(_ways(edges, types, reverse=True), seeds, max_depth).where("depth > 0")


def first_reached(reached: DataFrame, limit: int = 500) -> DataFrame:
    """At most `limit` reached nodes of each seed, the nearest first, then by id: a cap with an order."""
    near = Window.partitionBy("seed").orderBy("depth", "id")
    return reached.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= limit).drop("_r")


def rank_key(nodes: DataFrame, edges: DataFrame, compat: bool = False) -> DataFrame:
    """(key): what ranks of a graph are kept under. It changes with any edge; with compat only with the numbers of both."""
    n = nodes.agg(F.count("*").alias("n"))
    h = F.xxhash64("sourceId", "targetId", "type")
    m = edges.agg(F.count("*").alias("m"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h % 1_000_003), F.lit(0)).alias("s"))  # one row each
    parts = [F.col("n"), F.col("m")] + ([] if compat else [F.col("x"), F.col("s")])
    return n.join(m, F.lit(True)).select(F.concat_ws(":", *(p.cast("string") for p in parts)).alias("key"))


def trace(edges: DataFrame, seeds: DataFrame, forward: bool = True, max_depth: int = 10, types=DEPENDENCY_TYPES) -> DataFrame:
    return reach(_ways(edges, types, reverse=not forward), seeds, max_depth).where("depth > 0")


def layered_impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 6) -> DataFrame:
    return blast_radius(edges, seeds, max_depth).groupBy("seed", "depth").agg(F.count("*").alias("n"))


def risk(n: Column, high: int, medium: int) -> Column:
    return F.when(n > high, "high").when(n > medium, "medium").otherwise("low")


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(seed, direct_callers, affected, risk) with true depths."""
    direct = of_types(edges, ["calls"]).join(seeds.select(F.col("id").alias("targetId")), "targetId").groupBy(F.col("targetId").alias("seed")).agg(F.count("*").alias("direct_callers"))
    affected = blast_radius(edges, seeds, max_depth).groupBy("seed").agg(F.count("*").alias("affected"))
    out = seeds.select(F.col("id").alias("seed")).join(direct, "seed", "left").join(affected, "seed", "left").na.fill(0, ["direct_callers", "affected"])
    return out.withColumn("risk", risk(F.col("affected"), 20, 5))


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w): total weight by type between two different nodes."""
    w = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), EDGE_WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(DEFAULT_EDGE_WEIGHT)
    return edges.where("sourceId <> targetId").groupBy(F.col("sourceId").alias("src"), F.col("targetId").alias("dst")).agg(F.sum(w).alias("w"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, eps: float = 1e-6, seeds: DataFrame | None = None, seed_weight: float = 0.5) -> DataFrame:
    """(id, score), summing to 1. With seeds (id) the jump vector gives them seed_weight together, the others the rest.

    Edges with an end outside nodes, and loops, take no part. Dangling mass is spread by the jump vector.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if n == 0:
        return ids.withColumn("score", F.lit(0.0))
    chosen = ids.join(seeds.select("id").distinct(), "id", "left_semi") if seeds is not None else None
    k = chosen.count() if chosen is not None else 0
    if 0 < k < n:
        jump = ids.join(chosen.withColumn("_s", F.lit(True)), "id", "left").select("id", F.when(F.col("_s"), seed_weight / k).otherwise((1 - seed_weight) / (n - k)).alias("jump"))
    else:
        jump = ids.withColumn("jump", F.lit(1.0 / n))
    inside = weighted(edges).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = inside.groupBy("src").agg(F.sum("w").alias("total"))
    links = cut(inside.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")).repartition("src"))
    base = cut(jump.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").na.fill(True, ["dangling"]))
    rank = base.withColumn("score", F.col("jump"))
    dangling = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0))
    lost = rank.agg(dangling).first()[0]
    for _ in range(rounds):
        got = links.join(rank.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = rank.withColumnRenamed("score", "old").join(got, "id", "left")
        new = cut(new.select("id", "jump", "dangling", "old", ((1 - damping + damping * lost) * F.col("jump") + damping * F.coalesce("got", F.lit(0.0))).alias("score")))
        change, lost = new.agg(F.max(F.abs(F.col("score") - F.col("old"))), dangling).first()  # one pass for both
        rank = new.drop("old")
        if change < eps:
            break
    total = rank.agg(F.sum("score")).first()[0]
    return rank.select("id", (F.col("score") / total).alias("score"))


def top_ranked(nodes: DataFrame, ranks: DataFrame, limit: int, excluded=("file",)) -> DataFrame:
    return nodes.where(~F.col("type").isin(*excluded)).join(ranks, "id").orderBy(F.desc("score"), "id").limit(limit)


def table_of_contents(nodes: DataFrame, ranks: DataFrame, per_file: int = 10) -> DataFrame:
    best = Window.partitionBy("filePath").orderBy(F.desc("score"), "id")
    return nodes.where("type <> 'file'").join(ranks, "id").withColumn("position", F.row_number().over(best)).where(F.col("position") <= per_file)


def strongly_connected(moves: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of more than one node, named by their least node.

    Colouring: the least number that reaches each node is its colour; what reaches a colour's own node within the colour
    is its component. Found components and nodes that can't be in one leave the graph, and it starts again. Nodes get
    numbers, which are shuffled and sorted faster than names, and only what is new since the last step goes on.
    """
    moves = cut(moves.where("src <> dst"))
    names = cut(_both_ways(moves).select("id", F.monotonically_increasing_id().alias("n")))
    a, b = (names.select(F.col("id").alias(x), F.col("n").alias(f"_{x}")) for x in ("src", "dst"))
    live = cut(moves.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    found = None
    while True:
        ids = _both_ways(live)
        while True:  # nodes without an edge in or out can't be in a cycle
            ids = cut(ids)
            bad = _ends(live, "src").union(_ends(live, "dst")).join(ids, "id", "left_anti")
            if bad.isEmpty():
                break
            live = cut(_within(live, ids))
            ids = _both_ways(live)
        if live.isEmpty():
            break
        colour = cut(ids.withColumn("colour", F.col("id")).withColumn("new", F.lit(True)))
        while True:
            less = live.join(colour.where("new").select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
            colour = cut(colour.join(less, "id", "left").select("id", F.least("colour", "c").alias("colour"), F.coalesce(F.col("c") < F.col("colour"), F.lit(False)).alias("new")))
            if colour.where("new").isEmpty():
                break
        c_src, c_dst = (colour.select(F.col("id").alias(x), F.col("colour").alias(f"c_{x}")) for x in ("src", "dst"))
        back = cut(live.join(c_src, "src").join(c_dst, "dst").where("c_src = c_dst").select("src", "dst"))
        members = cut(colour.select("id", "colour", (F.col("id") == F.col("colour")).alias("seen"), (F.col("id") == F.col("colour")).alias("new")))
        while True:
            reached = back.join(members.where("new").select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.lit(True).alias("_r")).distinct()
            members = cut(members.join(reached, "id", "left").select("id", "colour", (F.col("seen") | F.col("_r").isNotNull()).alias("seen"), (~F.col("seen") & F.col("_r").isNotNull()).alias("new")))
            if members.where("new").isEmpty():
                break
        whole = members.where("seen").select("id", F.col("colour").alias("component"))
        found = whole if found is None else found.union(whole)
        rest = members.where("NOT seen").select("id")
        if rest.isEmpty():
            break
        live = cut(_within(live, rest))
    if found is None:
        return moves.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    named = found.join(names.select(F.col("n").alias("id"), F.col("id").alias("_name")), "id")
    many = named.groupBy("component").agg(F.count("*").alias("_n"), F.min("_name").alias("_least")).where("_n > 1")
    return named.join(many, "component").select(F.col("_name").alias("id"), F.col("_least").alias("component"))


def _ends(moves: DataFrame, end: str) -> DataFrame:
    return moves.select(F.col(end).alias("id")).distinct()


def _both_ways(moves: DataFrame) -> DataFrame:
    """(id) of nodes that edges leave and enter."""
    return _ends(moves, "src").join(_ends(moves, "dst"), "id", "left_semi")


def _within(moves: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between some nodes."""
    return moves.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


# Names that frameworks and runtimes call, which makes them entry points; files whose functions are called
# from outside; files of tests.
ENTRY_NAMES = (
    "main", "index", "app", "server", "init", "start", "run", "bootstrap", "setup", "configure", "register", "activate",
    "describe", "it", "test", "beforeAll", "afterAll", "beforeEach", "afterEach", "before", "after", "expect", "assert", "suite", "spec",
    "constructor", "render", "componentDidMount", "componentDidUpdate", "componentWillUnmount", "shouldComponentUpdate", "getSnapshotBeforeUpdate",
    "getDerivedStateFromProps", "getDerivedStateFromError", "componentDidCatch", "useEffect", "useState", "useCallback", "useMemo", "useRef", "useReducer", "useContext", "useLayoutEffect",
    "ngOnInit", "ngOnDestroy", "ngOnChanges", "ngDoCheck", "ngAfterContentInit", "ngAfterContentChecked", "ngAfterViewInit", "ngAfterViewChecked",
    "created", "mounted", "updated", "destroyed", "beforeCreate", "beforeMount", "beforeUpdate", "beforeDestroy", "activated", "deactivated", "errorCaptured",
    "onMounted", "onUnmounted", "onUpdated", "onBeforeMount", "onBeforeUpdate", "onBeforeUnmount", "onActivated", "onDeactivated",
    "get", "post", "put", "delete", "patch", "options", "head", "use", "all", "listen",
    "__init__", "__str__", "__repr__", "__eq__", "__hash__", "__len__", "__getitem__", "__setitem__", "__delitem__", "__iter__", "__next__", "__enter__", "__exit__", "__call__", "__del__", "__new__",
    "onCreate", "onStart", "onResume", "onPause", "onStop", "onDestroy", "toString", "equals", "hashCode", "compareTo",
    "cli", "command", "handler", "middleware", "default", "module", "exports",
)
ENTRY_FILES = "/(index|main|app|server|cli)[.][^/]+$|/(bin|scripts)/"
TEST_FILES = "[.](test|spec)[.][^/]+$|/(__tests__|tests?)/"


def dead_code(nodes: DataFrame, edges: DataFrame, types=("function", "method"), entry_names=ENTRY_NAMES, include_exported: bool = True) -> DataFrame:
    """Nodes of some types that nothing calls, with a confidence."""
    called = of_types(edges, ["calls"]).select(F.col("targetId").alias("id")).distinct()
    left = nodes.where(F.col("type").isin(*types) & ~F.col("name").isin(*entry_names)).join(called, "id", "left_anti")
    test, entry = F.lower("filePath").rlike(TEST_FILES), F.lower("filePath").rlike(ENTRY_FILES)
    hidden = F.col("visibility").isin("private", "protected")
    confidence = F.when(test, "low_confidence").when(F.col("isExported"), "possibly_dead").when(hidden | ~entry, "definitely_dead").otherwise("possibly_dead")
    left = left.withColumn("confidence", confidence)
    return left if include_exported else left.where("NOT isExported")


# What a confidence is called, the surest first.
CONFIDENCES = ("definitely_dead", "possibly_dead", "low_confidence")


def by_confidence(dead: DataFrame, least: str = "low_confidence", limit: int | None = None) -> DataFrame:
    """Dead code at least so sure, the surest first, then by file and line."""
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence"))
    out = dead.where(rank <= CONFIDENCES.index(least) + 1).orderBy(rank, "filePath", "startLine", "id")
    return out.limit(limit) if limit is not None else out


def dead_code_summary(dead: DataFrame, by: str = "confidence") -> DataFrame:
    total = Window.partitionBy()
    return dead.groupBy(by).agg(F.count("*").alias("n")).withColumn("percentage", F.floor(F.col("n") * 10000.0 / F.sum("n").over(total) + 0.5) / 100)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, total), each edge counted once at either end."""
    ends = edges.select(F.col("sourceId").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("targetId").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total"))


def hotspots(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The nodes of the highest degree; ids without a node take no place."""
    return nodes.join(degrees(edges), "id").orderBy(F.desc("total"), "id").limit(limit)


def neighbour_degree(edges: DataFrame) -> DataFrame:
    """(id, neighbours): distinct nodes at the other end of an edge either way."""
    both = edges.select(F.col("sourceId").alias("id"), F.col("targetId").alias("other")).union(edges.select(F.col("targetId"), F.col("sourceId"))).where("id <> other").distinct()
    return both.groupBy("id").agg(F.count("*").alias("neighbours"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("sourceId")), "sourceId", "left_semi").join(ids.select(F.col("id").alias("targetId")), "targetId", "left_semi")


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node. Both ends are looked up for the same rows, so edges are made once."""
    ids = nodes.select("id").distinct()
    source, target = (ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")) for end in ("sourceId", "targetId"))
    both = edges.select("sourceId", "targetId", "type").join(source, "sourceId", "left").join(target, "targetId", "left")
    return both.where("_sourceId IS NULL OR _targetId IS NULL").select("sourceId", "targetId", "type").distinct()


def god_functions(nodes: DataFrame, edges: DataFrame, fan_out: int = 8, total: int = 12) -> DataFrame:
    return nodes.where(F.col("type").isin("function", "method")).join(degrees(of_types(edges, ["calls"])), "id").where((F.col("out_degree") >= fan_out) | (F.col("total") >= total))


def instability(edges: DataFrame, module: DataFrame) -> DataFrame:
    """(module, ca, ce, instability) between modules (id, module): Ce / (Ca + Ce), one half where isolated."""
    a, b = (module.select(F.col("id").alias(x), F.col("module").alias(f"m_{x}")) for x in ("sourceId", "targetId"))
    cross = edges.join(a, "sourceId").join(b, "targetId").where("m_sourceId <> m_targetId").select("m_sourceId", "m_targetId").distinct()
    ce = cross.groupBy(F.col("m_sourceId").alias("module")).agg(F.count("*").alias("ce"))
    ca = cross.groupBy(F.col("m_targetId").alias("module")).agg(F.count("*").alias("ca"))
    out = module.select("module").distinct().join(ca, "module", "left").join(ce, "module", "left").na.fill(0, ["ca", "ce"])
    return out.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.5))


def module_relations(edges: DataFrame, module: DataFrame) -> DataFrame:
    """(source, target, type, n) over edges between different modules, all of them."""
    a, b = (module.select(F.col("id").alias(x), F.col("module").alias(m)) for x, m in (("sourceId", "source"), ("targetId", "target")))
    return edges.join(a, "sourceId").join(b, "targetId").where("source <> target").groupBy("source", "target", "type").agg(F.count("*").alias("n"))


def resolve_symbolic(edges: DataFrame, nodes: DataFrame, longest: int = 20) -> DataFrame:
    """Edges whose target is a class or interface name get its node's id (the least, of several)."""
    symbols = nodes.where(F.col("type").isin("class", "interface")).groupBy("name").agg(F.min("id").alias("_id"))
    symbolic = F.col("targetId").rlike("^[A-Z]") & (F.length("targetId") <= longest)
    out = edges.join(symbols, symbolic & (F.col("targetId") == F.col("name")), "left")
    return out.select("sourceId", F.coalesce("_id", "targetId").alias("targetId"), "type", F.col("_id").isNotNull().alias("resolved"))
