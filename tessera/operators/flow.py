"""Layers of files and symbols, and flows through the graph from a symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

# Names of symbols that tell their layer, the first one counts; signatures that do; what a step of a layer
# does and gives; names of event handlers and of HTTP handlers; caps of a trace.
SYMBOL_LAYERS = (
    ("event_handler", "^(handle|on)[A-Z]|_Click$|_Loaded$|_Changed$|_KeyDown$"), ("state_update", "^use[A-Z]|^set[A-Z].*State$"), ("api_call", "^fetch[A-Z]|^(get|post|put|delete)[A-Z].*Api$|Async$"),
    ("validator", "^validate|^sanitize|^check[A-Z]|^is[A-Z].*Valid$"), ("util", "^(format|parse|convert|transform|serialize|deserialize|encode|decode)[A-Z]"),
    ("database", "^(save|load|persist|query|find|fetch|insert|update|delete)(All|By|One|Many)?$"),
)
TYPE_LAYERS = {"route": "route", "component": "ui_component", "hook": "state_update"}
REQUEST_SIGNATURE, STORE_SIGNATURE = r"\b(req\s*,\s*res|request\s*,\s*response|ctx)\b", r"\b(db|prisma|model|repository)\b"
VERBS = {
    "ui_event": "triggers", "ui_component": "renders", "event_handler": "handles event via", "state_update": "updates state in", "api_call": "calls API via", "route": "routes to",
    "controller": "handles request in", "service": "processes in", "repository": "accesses data via", "database": "queries database in", "middleware": "passes through",
    "validator": "validates in", "util": "uses helper", "unknown": "executes",
}
PRODUCTS = {"database": "DB result", "api_call": "API response", "state_update": "Updated state", "ui_component": "JSX/HTML", "validator": "Validated data"}
EFFECTS = {"database": "DB", "state_update": "State", "api_call": "API"}
HANDLER = "^(handle|on)[A-Z]|_(Click|Loaded|Closing|Closed|Changed|SelectionChanged|KeyDown|KeyUp|MouseDown|MouseUp|DragEnter|Drop|Checked|Unchecked|GotFocus|LostFocus|TextChanged)$"
HTTP_NAME = r"(?i)\b(get|post|put|delete|patch)\b"
#: Steps that are broadcast at most.
MOST_BROADCAST = 200_000
MOST_STEPS, MOST_DEPTH, MOST_FLOWS, MOST_COMPONENTS = 50, 10, 30, 20


def _mapped(column: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), column), default)


def symbol_layer(n: DataFrame, file_layer: Column) -> Column:
    """A symbol's layer: by its type, its name, its signature, or else its file's."""
    sig = F.lower(F.coalesce("signature", F.lit("")))
    by_name = reduce(lambda c, x: c.when(F.col("name").rlike(x[1]), x[0]), SYMBOL_LAYERS, F.when(F.lit(False), ""))
    by_sig = F.when(sig.rlike(REQUEST_SIGNATURE), "controller").when(sig.rlike(STORE_SIGNATURE), "repository")
    return F.coalesce(_mapped(F.col("type"), TYPE_LAYERS, F.lit(None).cast("string")), by_name, by_sig, file_layer, F.lit("unknown"))


def with_layers(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with `layer`; files (path, layer) as quality.layers gives them."""
    known = files.select(F.col("path").alias("filePath"), F.col("layer").alias("_file"))
    return nodes.join(known, "filePath", "left").withColumn("layer", symbol_layer(nodes, F.col("_file"))).drop("_file")


def _few(rows: DataFrame) -> DataFrame:
    """Rows, which are cut, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def trace(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = MOST_DEPTH, most: int = MOST_STEPS) -> DataFrame:
    """(seed, step, depth, id, name, filePath, layer, action, produces): what happens from each seed (id) on, breadth first.

    From a node the flow goes to its callees, then along its other edges to nodes that aren't files. Steps of a depth are in
    order of the step that they come from, callees first, then by id; `most` steps a seed are taken (a feature). All seeds go
    at once, a depth a round; nodes have `layer`. Moves are made once; what is a node is asked of reached ids only.
    """
    moves = edges.select(F.col("sourceId").alias("src"), F.col("targetId").alias("dst"), (F.col("type") != "calls").cast("int").alias("kind"))
    moves = cut(moves.repartition("src").groupBy("src", "dst").agg(F.min("kind").alias("kind")))
    ends = nodes.select("id", (F.col("type") == "file").alias("_file"))
    seen = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.lit(0).alias("step")).distinct())
    front, at = seen, F.struct("step", "kind")
    for depth in range(1, max_depth + 1):
        hits = _few(front).join(moves, F.col("id") == F.col("src")).groupBy("seed", F.col("dst").alias("id")).agg(F.min(at).alias("at"), F.min(F.when(F.col("kind") == 0, at)).alias("call"))
        hits = cut(hits.join(_few(seen.select("seed", "id")), ["seed", "id"], "left_anti"))
        step = ends.join(_few(hits), "id").select("seed", "id", F.when(~F.col("_file"), F.col("at")).otherwise(F.col("call")).alias("at"))
        step = step.where("at IS NOT NULL").groupBy("seed", "id").agg(F.min("at").alias("at"))
        new = step.join(seen.groupBy("seed").agg(F.count("*").cast("int").alias("_n")), "seed").where(F.col("_n") < most)
        order = Window.partitionBy("seed").orderBy("at", "id")
        front = new.withColumn("_r", F.row_number().over(order)).where(F.col("_n") + F.col("_r") <= most)
        front = cut(front.select("seed", "id", F.lit(depth).alias("depth"), (F.col("_n") + F.col("_r") - 1).cast("int").alias("step")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return_type = F.nullif("returnType", F.lit("void")) if "returnType" in nodes.columns else F.lit(None).cast("string")
    steps = nodes.join(_few(seen), "id")
    action = F.concat(_mapped(F.col("layer"), VERBS, F.lit("executes")), F.lit(" "), F.col("name"), F.lit("()"))
    return steps.select("seed", "step", "depth", "id", "name", "filePath", "layer", action.alias("action"), F.coalesce(return_type, _mapped(F.col("layer"), PRODUCTS, F.lit(None).cast("string"))).alias("produces"))


def inline_calls(nodes: DataFrame, edges: DataFrame, bodies: DataFrame, most: int = 10) -> DataFrame:
    """Edges (sourceId, targetId, type) that no index has: of callables without callees, those siblings in the file that their
    body (id, text) names before a parenthesis; the `most` first by id of each (a feature). Names of a body meet the
    names of its file, so no body is searched for each sibling. Add them to edges before a trace."""
    busy = edges.where("type = 'calls'").select(F.col("sourceId").alias("id")).distinct()
    quiet = nodes.where(F.col("type").isin("function", "method", "class")).select("id", "filePath").join(busy, "id", "left_anti")
    called = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))
    named = quiet.join(bodies.select("id", called.alias("c")), "id").select("id", "filePath", F.explode("c").alias("name"))
    siblings = nodes.where(F.col("type").isin("function", "method")).select("filePath", "name", F.col("id").alias("other"))
    hits = named.join(siblings, ["filePath", "name"]).where("id <> other")
    first = F.row_number().over(Window.partitionBy("id").orderBy("other"))
    return hits.withColumn("_r", first).where(F.col("_r") <= most).select(F.col("id").alias("sourceId"), F.col("other").alias("targetId"), F.lit("calls").alias("type"))


def flow_summary(steps: DataFrame) -> DataFrame:
    """(seed, n_steps, n_files, n_effects, risk) of traces: writing to a database is high, critical beyond five files; a
    call of an interface is medium, high beyond three files; more than three files are medium."""
    has = lambda layer: F.max((F.col("layer") == layer).cast("int")) == 1
    one = steps.groupBy("seed").agg(F.count("*").alias("n_steps"), F.countDistinct("filePath").alias("n_files"), F.count_if(F.col("layer").isin(*EFFECTS)).alias("n_effects"), has("database").alias("_db"), has("api_call").alias("_api"))
    risk = F.when(F.col("_db"), F.when(F.col("n_files") > 5, "critical").otherwise("high")).when(F.col("_api") & (F.col("n_files") > 3), "high").when(F.col("_api") | (F.col("n_files") > 3), "medium").otherwise("low")
    return one.select("seed", "n_steps", "n_files", "n_effects", risk.alias("risk"))


def starts(nodes: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """Nodes (with layer) where flows start: routes (then functions and methods named after HTTP methods), handlers, or
    components; at most so many, in order of id (a feature)."""
    callable_ = F.col("type").isin("function", "method")
    rank = {
        "route": F.when((F.col("type") == "route") | ((F.col("type") == "function") & (F.col("layer") == "route")), 0).when(callable_ & F.col("name").rlike(HTTP_NAME), 1),
        "handler": F.when(callable_ & F.col("name").rlike(HANDLER), 0), "component": F.when((F.col("type") == "component") | ((F.col("type") == "class") & (F.col("layer") == "ui_component")), 0),
    }[kind]
    most = most or (MOST_COMPONENTS if kind == "component" else MOST_FLOWS)
    return nodes.withColumn("_rank", rank).where("_rank IS NOT NULL").orderBy("_rank", "id").limit(most).drop("_rank")


def find_route(nodes: DataFrame, pattern: str) -> DataFrame:
    """The node that a route's pattern means: a route whose name holds it, else a function whose name or signature does."""
    hit = lambda c: F.contains(F.lower(c), F.lit(pattern.lower()))
    rank = F.when((F.col("type") == "route") & F.contains("name", F.lit(pattern)), 0).when(F.col("type").isin("route", "function") & (hit("name") | hit("signature")), 1)
    return nodes.withColumn("_rank", rank).where("_rank IS NOT NULL").orderBy("_rank", "id").limit(1).drop("_rank")


def interaction_map(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Flows of routes and handlers, components with their handlers, children and data sources, and symbols by layer."""
    routes, handlers = (flow_summary(trace(nodes, edges, starts(nodes, k).select("id"), 8)) for k in ("route", "handler"))
    parts = cut(starts(nodes, "component"))
    inside = nodes.select("filePath", F.col("name").alias("_n"), F.coalesce("signature", F.lit("")).alias("_s")).join(parts.select("id", "filePath"), "filePath")
    source = "(?i)fetch|axios|useQuery|useSWR|api\\."
    own = inside.groupBy("id").agg(F.count_if(F.col("_n").rlike("^(handle|on)[A-Z]")).alias("n_handlers"), F.count_if(F.col("_n").rlike(source) | F.col("_s").rlike(source)).alias("n_sources"))
    calls = edges.where("type = 'calls'").select(F.col("sourceId").alias("id"), F.col("targetId").alias("_t"))
    kids = calls.join(parts.select("id"), "id").join(nodes.select(F.col("id").alias("_t"), "type", "name"), "_t").where("type = 'component' OR name RLIKE '^[A-Z]'").groupBy("id").agg(F.count("*").alias("n_children"))
    components = parts.select("id", "name").join(own, "id", "left").join(kids, "id", "left").na.fill(0)
    return {"routes": routes, "handlers": handlers, "components": components, "layers": nodes.groupBy("layer").agg(F.count("*").alias("n"))}


def layer_overview(nodes: DataFrame) -> DataFrame:
    """(layer, files, symbols, keys): files and callables or classes by layer, the first 15 names of them."""
    symbol = F.col("type").isin("function", "method", "class")
    names = F.array_join(F.slice(F.array_sort(F.collect_set(F.when(symbol, F.col("name")))), 1, 15), ",")
    return nodes.groupBy("layer").agg(F.countDistinct("filePath").alias("files"), F.count_if(symbol).alias("symbols"), names.alias("keys"))
