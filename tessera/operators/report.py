"""Reports on a project: architecture, project map, digests, repo map, explanations of a symbol. One table a section."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph, intervals
from tessera.operators.context import quarter_tokens
from tessera.session import cut

# A path's layer by the first of these that it shows; kinds of entry points by file; limits of a report.
PATH_LAYERS = (
    ("ui", "component|view|page|screen|widget|ui"), ("route", "route|router|endpoint"), ("controller", "controller|handler"), ("service", "service|business|logic|use.?case"),
    ("data", "repo|repository|dao|data.?access|store"), ("model", "model|entity|schema|dto"), ("middleware", "middleware|guard|interceptor|filter"), ("test", r"test|spec|__test__|\.test\.|\.spec\."),
    ("util", "util|helper|lib|common|shared"), ("config", "config|env|setting"), ("tool", "tool|mcp|plugin"), ("types", r"types?\.ts$|interface|types?/"),
)
ENTRIES = (
    ("main", r"/index\.(ts|js|tsx|jsx|mjs)$"), ("main", r"/main\.(ts|js|py|go|rs|java)$"), ("app", r"/app\.(ts|js|tsx|jsx|py)$"), ("app", r"/App\.(tsx|jsx|vue|svelte)$"), ("server", r"/server\.(ts|js|py)$"),
    ("main", r"/Program\.cs$"), ("startup", r"/Startup\.cs$"), ("app", r"/App\.xaml\.cs$"), ("ui", r"/MainWindow\.xaml\.cs$"), ("cli", r"/manage\.py$"), ("server", r"/wsgi\.py$"), ("server", r"/asgi\.py$"),
    ("lib", r"/lib\.rs$"), ("module", r"/mod\.rs$"), ("cli", r"/cmd/.*\.go$"), ("routing", r"(?i)/routes?\.(ts|js|py)$"), ("api", r"/api/.*\.(ts|js|py)$"),
)
MODULE_LAYERS = {
    "Business Logic": ("services", "controllers", "handlers", "core", "domain", "application", "features"), "Data/Infrastructure": ("models", "data", "db", "database", "repositories", "infra", "infrastructure", "migrations"),
    "Shared/Utilities": ("utils", "helpers", "common", "shared", "lib", "types", "config", "constants"),
}
NAMINGS = (("camelCase", r"^[a-z][a-zA-Z]+\.\w+$"), ("kebab-case", r"^[a-z]+-[a-z][\w-]*\.\w+$"), ("PascalCase", r"^[A-Z][a-zA-Z]+\.\w+$"), ("snake_case", r"^[a-z]+_[a-z][\w_]*\.\w+$"))
CALLABLE = ("function", "method")


def _first(column: Column, table, default: str | None = None) -> Column:
    """The name of the first (name, pattern) that the column matches."""
    out = reduce(lambda c, x: c.when(column.rlike(x[1]), x[0]), table, F.when(F.lit(False), ""))
    return out if default is None else out.otherwise(default)


def path_layer(path: Column) -> Column:
    return _first(F.lower(path), PATH_LAYERS, "unknown")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def top_folder(path: Column) -> Column:
    part = F.split(F.regexp_replace(path, "^/+", ""), "/")
    return F.when(F.size(part) > 1, F.get(part, F.lit(0))).otherwise(".")


def _round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


# --- architecture


def complexity_totals(nodes: DataFrame, params: Column) -> DataFrame:
    """One row: functions, classes and interfaces, functions a file, the file of the most of them, parameters a function and
    the function of the most. Ties go to the least name."""
    is_call = F.col("type").isin(*CALLABLE)
    files = nodes.groupBy("filePath").agg(F.count_if(is_call).alias("n"), F.count_if(F.col("type") == "class").alias("c"), F.count_if(F.col("type") == "interface").alias("i"))
    per_file = files.agg(
        F.count("*").alias("files"), F.sum("n").alias("functions"), F.sum("c").alias("classes"), F.sum("i").alias("interfaces"), F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), "filePath"))).alias("most"),
    )
    calls = nodes.where(is_call).select("qualifiedName", params.alias("p"))
    per_call = calls.agg(F.avg("p").alias("params"), F.min(F.struct((-F.col("p")).alias("p"), "qualifiedName")).alias("top"))
    x = per_file.join(per_call, F.lit(True))  # one row each
    return x.select("functions", "classes", "interfaces", _round2(F.col("functions") / F.col("files")).alias("functions_per_file"), F.col("most.filePath").alias("largest_file"), (-F.col("most.n")).alias("largest_functions"), _round2(F.col("params")).alias("params_per_function"), F.col("top.qualifiedName").alias("most_params_name"), (-F.col("top.p")).alias("most_params"))


def layer_counts(nodes: DataFrame, layers) -> DataFrame:
    """(layer, files, symbols) by (name, pattern) of a path; a file may be of several layers."""
    files = nodes.groupBy("filePath").agg(F.count_if(F.col("type") != "file").alias("n"))
    hits = F.filter(F.array(*(F.when(F.col("filePath").rlike(p), F.lit(n)) for n, p in layers)), lambda x: x.isNotNull())
    return files.select("n", F.explode(F.array_distinct(hits)).alias("layer")).groupBy("layer").agg(F.count("*").alias("files"), F.sum("n").alias("symbols"))


def entry_points(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(filePath, kind) of files that are entry points, in order of path."""
    out = nodes.select("filePath").distinct().withColumn("kind", _first(F.col("filePath"), ENTRIES)).where("kind IS NOT NULL").orderBy("filePath")
    return out if limit is None else out.limit(limit)


def test_totals(nodes: DataFrame) -> DataFrame:
    """One row (test_files, source_files, ratio)."""
    files = nodes.select("filePath").distinct().select(F.lower("filePath").rlike(graph.TEST_FILES).alias("t"))
    one = files.agg(F.count_if("t").alias("test_files"), F.count_if(~F.col("t")).alias("source_files"))
    return one.withColumn("ratio", F.when(F.col("source_files") > 0, _round2(F.col("test_files") / F.col("source_files"))).otherwise(0.0))


def architecture(nodes: DataFrame, edges: DataFrame, params: Column) -> dict[str, DataFrame]:
    """Sections: languages, layers, entries, hotspots, tests, complexity, packages (files and symbols by folder)."""
    files = nodes.groupBy("filePath", "language").agg(F.count("*").alias("n"))
    return {
        "languages": files.groupBy("language").agg(F.count("*").alias("files"), F.sum("n").alias("symbols")), "layers": layer_counts(nodes, PATH_LAYERS), "entries": entry_points(nodes),
        "hotspots": hotspots_with_ends(nodes, edges), "tests": test_totals(nodes), "complexity": complexity_totals(nodes, params),
        "packages": nodes.groupBy(F.regexp_replace("filePath", "/[^/]*$", "").alias("folder")).agg(F.countDistinct("filePath").alias("files"), F.count("*").alias("symbols")),
    }


def hotspots_with_ends(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """(id, in_degree, out_degree, total) of the ids of the highest degree; one that is no node takes a place, then goes."""
    top = graph.degrees(edges).orderBy(F.desc("total"), "id").limit(limit)
    return top.join(nodes.select("id"), "id")


# --- the project map


def modules(nodes: DataFrame) -> DataFrame:
    """(module, files, symbols, public, layer) by top folder; a root of fewer than three files is none."""
    public = F.col("isExported") | (F.col("visibility") == "public")
    m = nodes.groupBy(top_folder(F.col("filePath")).alias("module")).agg(F.countDistinct("filePath").alias("files"), F.count("*").alias("symbols"), F.count_if(public).alias("public"))
    layer = reduce(lambda c, kv: c.when(F.lower("module").isin(*kv[1]), kv[0]), MODULE_LAYERS.items(), F.when(F.lit(False), ""))
    return m.where("module <> '.' OR files >= 3").withColumn("layer", layer)


def abstractions(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(kind, name, filePath, methods): public classes by their methods (within their lines), then interfaces and functions."""
    open_ = nodes.where("isExported OR visibility = 'public'")
    classes = open_.where("type = 'class'").select("id", "name", "filePath", F.col("startLine").alias("_a"), F.col("endLine").alias("_b"))
    methods = nodes.where("type = 'method'").groupBy("filePath", F.col("startLine").alias("_s"), F.col("endLine").alias("_e")).agg(F.count("*").alias("_n"))
    spans = classes.select("filePath", "_a", "_b").distinct()  # symbols of equal lines are counted together
    inside = spans.join(methods, "filePath").where("_s >= _a AND _e <= _b").groupBy("filePath", "_a", "_b").agg(F.sum("_n").alias("methods"))
    top = classes.join(inside, ["filePath", "_a", "_b"], "left").na.fill(0, ["methods"]).orderBy(F.desc("methods"), "name", "id").limit(limit)
    out = top.select(F.lit("class").alias("kind"), "name", "filePath", "methods")
    for kind in ("interface", "function"):
        out = out.unionAll(open_.where(F.col("type") == kind).orderBy("name", "id").limit(limit).select(F.lit(kind), "name", "filePath", F.lit(0).cast("long")))
    return out


def naming(nodes: DataFrame) -> DataFrame:
    """(convention, n, share) of file names; the prevailing one is more than three tenths of all."""
    files = nodes.select(base_name(F.col("filePath")).alias("f"), "filePath").distinct()
    hits = F.filter(F.array(*(F.when(F.col("f").rlike(p), F.lit(n)) for n, p in NAMINGS)), lambda x: x.isNotNull())
    total = files.agg(F.count("*").alias("_t"))  # one row
    n = files.select(F.explode(hits).alias("convention")).groupBy("convention").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total), F.lit(True)).select("convention", "n", _round2(F.col("n") / F.col("_t")).alias("share"))


def language_patterns(nodes: DataFrame) -> DataFrame:
    """(language, n, share, async_ratio, static_ratio, exported_ratio, test_ratio) of symbols by language."""
    ratio = lambda c: F.round(F.avg(c.cast("int")), 6)
    counts = nodes.groupBy("language").agg(
        F.count("*").alias("n"), ratio(F.col("isAsync")).alias("async_ratio"), ratio(F.col("isStatic")).alias("static_ratio"),
        ratio(F.col("isExported")).alias("exported_ratio"), ratio(F.contains("filePath", F.lit("/test/"))).alias("test_ratio"),
    )
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row a language


def code_patterns(nodes: DataFrame) -> DataFrame:
    """(pattern, n) of all symbols: kinds of visibility, and whether classes or functions prevail."""
    seen = nodes.groupBy(F.concat(F.lit("visibility "), F.coalesce("visibility", F.lit("unknown"))).alias("pattern")).agg(F.count("*").alias("n"))
    sums = nodes.agg(F.count_if(F.col("type") == "class").alias("c"), F.count_if(F.col("type").isin("function", "method")).alias("f"))
    style = sums.select(F.when(F.col("c") > F.col("f"), "class heavy").when(F.col("f") > 3 * F.col("c"), "function heavy").otherwise("mixed").alias("pattern"), (F.col("c") + F.col("f")).alias("n"))
    return seen.unionAll(style)


# --- digests


def symbol_list(nodes: DataFrame, most: int = 15) -> DataFrame:
    """(filePath, layer, symbols) of files: their symbols by line as 'name:line', cut after `most`, which is the form's."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("type") != "file", F.struct("startLine", "name", "id"))))
    rows = nodes.groupBy("filePath").agg(ordered.alias("x"))
    text = F.array_join(F.transform(F.slice("x", 1, most), lambda s: F.concat_ws(":", s["name"], s["startLine"].cast("string"))), " ")
    return rows.select("filePath", path_layer(F.col("filePath")).alias("layer"), F.concat(text, F.when(F.size("x") > most, F.concat(F.lit(" +"), (F.size("x") - most).cast("string"))).otherwise("")).alias("symbols"))


def folder_lines(nodes: DataFrame, most: int = 15) -> DataFrame:
    """(folder, at, line): a line a file, with its layer and symbols, in order within the folder."""
    rows = symbol_list(nodes, most).withColumn("folder", F.regexp_replace("filePath", "/[^/]*$", ""))
    tag = F.when(F.col("layer") != "unknown", F.concat(F.lit("["), "layer", F.lit("] "))).otherwise("")
    line = F.concat(F.lit("  "), tag, base_name(F.col("filePath")), F.when(F.col("symbols") != "", F.concat(F.lit(": "), "symbols")).otherwise(""))
    return rows.select("folder", F.col("filePath").alias("at"), line.alias("line"))


def digest(nodes: DataFrame, budget: int, most: int = 15) -> DataFrame:
    """(folder, at, line, used): each folder's files as far as its budget of tokens reaches, cut from the bottom. The first
    line is the folder with its number of files."""
    files = folder_lines(nodes, most)
    heads = files.groupBy("folder").agg(F.count("*").alias("n")).select("folder", F.lit("").alias("at"), F.concat("folder", F.lit("/ ("), F.col("n").cast("string"), F.lit(" files)")).alias("line"))
    upto = Window.partitionBy("folder").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return heads.unionAll(files).withColumn("used", F.sum(quarter_tokens(F.col("line")) + 1).over(upto)).where(F.col("used") <= budget)


def layer_line(nodes: DataFrame) -> DataFrame:
    """One row (line): layers of files with their numbers, the most first."""
    n = nodes.select("filePath").distinct().groupBy(path_layer(F.col("filePath")).alias("l")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "l")))
    return n.agg(F.concat(F.lit("LAYERS: "), F.array_join(F.transform(ordered, lambda x: F.concat(x["l"], F.lit("("), (-x["n"]).cast("string"), F.lit(")"))), " ")).alias("line"))


def skeleton(nodes: DataFrame, path: str) -> DataFrame:
    """(startLine, line) of a file's symbols: signatures by line, indented below the symbol that holds them."""
    mine = nodes.where((F.col("filePath") == path) & (F.col("type") != "file")).select("id", "startLine", "endLine", "signature")
    spans = cut(mine.groupBy("startLine", "endLine").agg(F.count("*").alias("n")))  # symbols of equal lines are equally deep
    around = spans.select(F.col("startLine").alias("_a"), F.col("endLine").alias("_b"), F.col("n").alias("_n"))
    wider = (F.col("_a") <= F.col("startLine")) & (F.col("_b") >= F.col("endLine")) & (F.col("_b") - F.col("_a") > F.col("endLine") - F.col("startLine"))
    depth = spans.join(around, wider).groupBy("startLine", "endLine").agg(F.sum("_n").cast("int").alias("d"))
    rows = mine.join(depth, ["startLine", "endLine"], "left").na.fill(0, ["d"])
    return rows.select("startLine", "id", F.concat(F.repeat(F.lit("  "), F.col("d")), "signature").alias("line")).orderBy("startLine", "id").drop("id")


def verify_digest(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, name, state) of claims (path, name, line): exact, moved, or missing."""
    known = nodes.select(F.col("filePath").alias("path"), "name", F.col("startLine").alias("_l"))
    best = claims.join(known, ["path", "name"], "left").groupBy("path", "name", "line").agg(F.min(F.abs(F.col("_l") - F.col("line"))).alias("d"))
    return best.select("path", "name", F.when(F.col("d").isNull(), "missing").when(F.col("d") == 0, "exact").otherwise("moved").alias("state"))


#: Parts of a file's entries of one cost, each of which names its first ones.
_SALTS = 256


def repo_map(nodes: DataFrame, ranks: DataFrame, budget: int) -> DataFrame:
    """(place, line): a map within a budget of tokens, files by their best symbol, symbols by line with the first line of
    a short comment. An entry that doesn't fit is passed over; the first file heading that doesn't fit ends the map.

    Only files that can be reached take part: each heading costs a token at least. What is used only grows, so of all entries of
    one cost the first ones are taken, and no more than the budget holds: only those, and each file's first, meet in one task.
    """
    best = nodes.where("type <> 'file'").join(ranks, "id")
    files = best.groupBy("filePath").agg(F.max("score").alias("top")).orderBy(F.desc("top"), "filePath").limit(budget)
    head = F.split(F.coalesce("docComment", F.lit("")), "\n") if "docComment" in nodes.columns else F.array(F.lit(""))
    first = F.trim(F.get(head, F.lit(0)))
    entry = F.concat(F.when((first != "") & (F.length(first) <= 80), F.concat(F.lit("  /** "), first, F.lit(" */\n"))).otherwise(""), F.when(F.contains("qualifiedName", F.lit(".")), "  ").otherwise(""), F.col("signature"))
    rows = best.join(F.broadcast(files), "filePath").select("top", "filePath", "startLine", "id", entry.alias("entry"))
    places = [F.desc("top"), "filePath", "startLine", "id"]
    cost = F.ceil(F.length(F.coalesce("entry", F.lit(""))) / 4).cast("long")
    rows = rows.withColumn("_cost", F.least(cost, F.lit(budget + 1).cast("long"))).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    for parts in (["filePath", "_cost", "_salt"], ["filePath", "_cost"], ["_cost"]):  # of a file and a salt, of a file, of all
        nth = F.row_number().over(Window.partitionBy(*parts).orderBy(*places))
        first = F.col("_nth") == 1 if "filePath" in parts else F.row_number().over(Window.partitionBy("filePath").orderBy(*places)) == 1
        rows = rows.withColumn("_nth", nth).withColumn("_first", first)
        rows = rows.where((F.col("_cost") == 0) | F.col("_first") | (F.col("_nth") * F.col("_cost") <= budget))
    rows = rows.select("top", "filePath", "startLine", "id", "entry").repartition(1).sortWithinPartitions(*places)

    def run(batches):
        used, place, file, over = 0, 0, None, False
        for batch in batches:
            out = []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if over:
                    break
                if path != file:
                    head, file = f"\n// {path}", path
                    cost = -(-len(head) // 4)
                    if used + cost > budget:
                        over = True
                        break
                    used += cost
                    out.append(head)
                cost = -(-len(text or "") // 4)
                if used + cost <= budget:
                    used += cost
                    out.append(text or "")
            yield pa.RecordBatch.from_arrays([pa.array(range(place, place + len(out)), pa.int32()), pa.array(out, pa.string())], ["place", "line"])
            place += len(out)

    return rows.mapInArrow(run, "place int, line string")


# --- symbols


def find_references(nodes: DataFrame, edges: DataFrame, lines: DataFrame, name: str, most: int = 20) -> DataFrame:
    """(kind, file, line_no, text): callers of the least node of a name; if there are none, lines (doc, line_no, line) that
    hold the name, the first `most` of each file."""
    first = nodes.where(F.col("name") == name).orderBy("id").limit(1).select("id")
    calls = edges.where("type = 'calls'").join(first.withColumnRenamed("id", "targetId"), "targetId").select(F.col("sourceId").alias("id"))
    callers = nodes.join(calls, "id").select(F.lit("caller").alias("kind"), F.col("filePath").alias("file"), F.col("startLine").alias("line_no"), F.col("name").alias("text"))
    if not callers.isEmpty():
        return callers
    hits = lines.where(F.contains("line", F.lit(name))).withColumn("_r", F.row_number().over(Window.partitionBy("doc").orderBy("line_no"))).where(F.col("_r") <= most)
    return hits.select(F.lit("text").alias("kind"), F.col("doc").alias("file"), F.col("line_no").cast("int").alias("line_no"), F.col("line").alias("text"))


def explain(nodes: DataFrame, edges: DataFrame, id_: str, layer: Column | None = None, depth: int = 2) -> dict[str, DataFrame]:
    """Sections on a symbol: itself (with layer and risk), callers, callees, what depends on it, ten others of its file."""
    me = cut(nodes.where(F.col("id") == id_))
    seed = me.select("id")
    blast = cut(graph.blast_radius(edges, seed, depth).select("id", "depth"))
    n = blast.agg(F.count("*").alias("affected"))
    risk = F.when(F.col("affected") > 20, "critical").when(F.col("affected") > 10, "high").when(F.col("affected") > 3, "medium").otherwise("low")
    siblings = nodes.join(me.select("filePath", F.col("id").alias("_me")), "filePath").where("id <> _me AND type <> 'file'").orderBy("startLine", "id").limit(10)
    head = me.join(n, F.lit(True)).withColumn("risk", risk)
    return {
        "symbol": head.withColumn("layer", path_layer(F.col("filePath")) if layer is None else layer), "callers": graph.callers(nodes, edges, id_), "callees": graph.callees(nodes, edges, id_),
        "blast": blast.join(nodes, "id"), "siblings": siblings.drop("_me"),
    }


def important(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of the highest degree for a drawing, and the edges between them."""
    top = cut(graph.hotspots(nodes, edges, limit))
    return top, graph.induced(edges, top)


# --- folders and files


def list_dir(files: DataFrame, folder: str) -> DataFrame:
    """(name, is_folder, children, size) of a folder of files (path, size): folders first, then by name."""
    root = folder.rstrip("/") + "/"
    rest = files.where(F.startswith("path", F.lit(root))).select(F.split(F.substring("path", len(root) + 1, 100_000), "/").alias("p"), "size")
    rows = rest.groupBy(F.get("p", F.lit(0)).alias("name"), (F.size("p") > 1).alias("is_folder")).agg(F.count_distinct(F.get("p", F.lit(1))).alias("children"), F.sum("size").alias("size"))
    return rows.orderBy(F.desc("is_folder"), "name")


def explore(files: DataFrame, limit: int = 10_000) -> DataFrame:
    """(path, size, depth, kind) of at most `limit` files by path: what a first look shows, with readmes and configurations."""
    name = F.lower(base_name(F.col("path")))
    kind = F.when(name.rlike("^readme"), "readme").when(name.rlike(r"^(package\.json|tsconfig\.json|pyproject\.toml|cargo\.toml|go\.mod|dockerfile|makefile)$|\.(ya?ml|toml|ini)$"), "config").otherwise("file")
    return files.select("path", "size", (F.size(F.split("path", "/")) - 1).alias("depth"), kind.alias("kind")).orderBy("path").limit(limit)


def snippet_lines(nodes: DataFrame, lines: DataFrame, name: str, around: int = 3) -> DataFrame:
    """(id, line_no, line): the code of the symbols of a name, with lines around it."""
    mine = nodes.where(F.col("name") == name).select("id", F.col("filePath").alias("doc"), F.greatest(F.lit(1), F.col("startLine") - around).alias("_a"), (F.col("endLine") + around).alias("_b"))
    return lines.join(mine, "doc").where("line_no BETWEEN _a AND _b").select("id", "line_no", "line")


def containing(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(path, line_no, id) of points (path, line_no): the innermost symbol around each."""
    return intervals.innermost(nodes.where("type <> 'file'").select(F.col("filePath").alias("path"), "id", "startLine", "endLine"), points)


def function_metrics(nodes: DataFrame, texts: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, loc, cyclomatic, cognitive, nesting, health, risk) of functions and methods by their own lines in texts (doc,
    text), the worst first."""
    from tessera.operators import quality

    spans = nodes.where(F.col("type").isin(*CALLABLE)).select("id", F.col("filePath").alias("_p"), "startLine", "endLine")
    body = texts.join(spans, texts["doc"] == spans["_p"]).select(F.col("id").alias("doc"), F.array_join(F.slice(F.split("text", "\n", -1), F.col("startLine"), F.greatest(F.lit(1), F.col("endLine") - F.col("startLine") + 1)), "\n").alias("text"))
    out = quality.health(quality.complexity(body)).withColumnRenamed("doc", "id").orderBy("health", F.desc("cyclomatic"), "id")
    return out if limit is None else out.limit(limit)


def quality_rollup(metrics: DataFrame) -> DataFrame:
    """One row: functions, mean complexity and health to a tenth, and how many are at each risk."""
    tenth = lambda c: F.floor(F.avg(c) * 10 + 0.5) / 10
    return metrics.agg(F.count("*").alias("n"), tenth("cyclomatic").alias("cyclomatic"), tenth("health").alias("health"), *(F.count_if(F.col("risk") == r).alias(r) for r in ("low", "medium", "high", "critical")))


# --- smells of files


def file_smells(nodes: DataFrame, edges: DataFrame, most_functions: int = 15, most_lines: int = 300) -> DataFrame:
    """(filePath, smell): large files by functions or lines, files without exports, and orphans, which no edge joins to
    another file."""
    one = nodes.groupBy("filePath").agg(F.count_if(F.col("type").isin(*CALLABLE)).alias("n"), F.max("endLine").alias("lines"), F.max(F.col("isExported").cast("int")).alias("e"))
    a, b = (nodes.select(F.col("id").alias(x), F.col("filePath").alias(f)) for x, f in (("sourceId", "_from"), ("targetId", "_to")))
    across = edges.select("sourceId", "targetId").join(a, "sourceId").join(b, "targetId").where("_from <> _to").select("_from", "_to").distinct()
    joined = across.select(F.col("_from").alias("filePath")).union(across.select("_to")).distinct()
    orphans = one.join(joined, "filePath", "left_anti").select("filePath", F.lit("orphan").alias("smell"))
    marks = F.filter(F.array(F.when((F.col("n") > most_functions) | (F.col("lines") > most_lines), "large"), F.when(F.col("e") == 0, "no exports")), lambda x: x.isNotNull())
    return orphans.unionAll(one.select("filePath", F.explode(marks).alias("smell")))
