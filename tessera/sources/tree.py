"""Source trees as tables: scan, languages, symbols, imports, inheritance and calls.

Files are read whole by Spark's own reader. Python files are parsed by the standard library's parser, other languages
by a small table of declaration patterns; either runs in Arrow batches. Everything after that is relational.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import node_id
from tessera.operators.text import glob_pattern

# Extensions and the languages they stand for.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "scala": "scala", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cs": "csharp",
    "rb": "ruby", "php": "php", "swift": "swift", "sh": "shell", "sql": "sql", "lua": "lua", "ex": "elixir", "hs": "haskell", "dart": "dart", "r": "r", "jl": "julia",
    "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "proto": "protobuf", "vue": "vue", "zig": "zig",
}
BASENAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "rakefile": "ruby", "gemfile": "ruby", "jenkinsfile": "groovy"}
SKIPPED = ("node_modules", ".git", "dist", "build", "out", "target", "vendor", "__pycache__", ".venv", "coverage")
MAX_FILE_SIZE = 2 * 1024 * 1024

_ID = r"[A-Za-z_$][\w$]*"
#: Declarations by language: (symbol type, pattern with the name in group 1). Patterns look at a line's start.
DECLARATIONS = {
    "typescript": [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})"), ("interface", rf"^\s*(?:export\s+)?interface\s+({_ID})"), ("type_alias", rf"^\s*(?:export\s+)?type\s+({_ID})\s*[=<]"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+({_ID})"), ("constant", rf"^(?:export\s+)?const\s+({_ID})"), ("variable", rf"^(?:export\s+)?(?:let|var)\s+({_ID})"), ("method", rf"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)({_ID})\s*\([^)]*\)\s*(?::[^{{]+)?\{{")],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("class", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("interface", r"^\s*(?:pub\s+)?trait\s+(\w+)")],
    "java": [("class", r"^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("enum", r"^\s*(?:public\s+)?enum\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(")],
    "ruby": [("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(?:self\.)?(\w+)")],
    "php": [("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)")],
    "swift": [("class", r"^\s*(?:(?:public|private|open|final|internal)\s+)*(?:class|struct|actor)\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?protocol\s+(\w+)"), ("enum", r"^\s*(?:public\s+)?enum\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|static|override|open)\s+)*func\s+(\w+)")],
    "c": [("class", r"^\s*(?:typedef\s+)?(?:struct|union)\s+(\w+)\s*\{"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(\w+)"), ("function", r"^(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w\s*]*?[\s*](\w+)\s*\([^;]*\)\s*\{"), ("constant", r"^#define\s+(\w+)")],
    "cpp": [("class", r"^\s*(?:class|struct)\s+(\w+)(?![\w\s]*;)"), ("namespace", r"^\s*namespace\s+(\w+)"), ("enum", r"^\s*enum\s+(?:class\s+)?(\w+)"), ("function", r"^(?:static\s+|inline\s+|virtual\s+)*[A-Za-z_][\w:<>,\s*&]*?[\s*&](\w+)\s*\([^;]*\)[^;]*\{")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)")], "shell": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{")], "r": [("function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(")],
    "elixir": [("module", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+(\w+)")], "julia": [("function", r"^\s*function\s+(\w+)"), ("class", r"^\s*(?:mutable\s+)?struct\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")],
    "haskell": [("class", r"^(?:data|newtype)\s+(\w+)"), ("interface", r"^class\s+(?:.*=>\s*)?(\w+)"), ("function", r"^([a-z]\w*)\s*::")], "dart": [("class", r"^\s*(?:abstract\s+)?class\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("function", r"^(?:[\w<>?]+\s+)(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{")],
    "sql": [("class", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp\w*\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)")], "protobuf": [("class", r"^\s*message\s+(\w+)"), ("interface", r"^\s*service\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("method", r"^\s*rpc\s+(\w+)")],
    "zig": [("function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*struct")],
}
DECLARATIONS["javascript"] = DECLARATIONS["vue"] = DECLARATIONS["typescript"]
DECLARATIONS["csharp"] = DECLARATIONS["kotlin"] = DECLARATIONS["scala"] = DECLARATIONS["java"]
IMPORTS = {
    "typescript": r"""(?:import|export)\s[^'"]*?from\s+['"]([^'"]+)['"]|import\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]""",
    "python": r"^\s*from\s+([\w.]+)\s+import|^\s*import\s+([\w.]+)", "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', "rust": r"^\s*use\s+([\w:]+)",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""", "php": r"^\s*use\s+([\w\\]+)", "c": r"""^\s*#include\s+[<"]([^>"]+)[>"]""",
}
IMPORTS["javascript"] = IMPORTS["vue"] = IMPORTS["typescript"]
IMPORTS["kotlin"] = IMPORTS["scala"] = IMPORTS["java"]
IMPORTS["cpp"] = IMPORTS["c"]
_BASES = r"\bextends\s+([\w.$]+)|\bimplements\s+([\w.$, ]+)"

_SYMBOLS = "path string, language string, type string, name string, parent string, startLine int, endLine int, signature string, isAsync boolean, isStatic boolean, isExported boolean, visibility string, docComment string"
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def language_of(path: Column) -> Column:
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    return F.coalesce(F.try_element_at(table(LANGUAGES), F.regexp_extract(base, "[.]([^.]+)$", 1)), F.try_element_at(table(BASENAMES), base))


def ignore_rule(line: str, folder: str) -> tuple[bool, str] | None:
    """(keeps, pattern of paths) of a line of an ignore file in a folder: ! keeps again, a slash binds to the folder."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    glob = line.removeprefix("!")
    bound = "/" in glob.rstrip("/")
    body = glob_pattern(glob.strip("/"))[1:-1]
    at = re.sub("^file:/+", "", folder)  # readers write local paths with one slash or three
    return keeps, ("^file:/+" if folder.startswith("file:") else "^") + re.escape(at) + "/" + ("" if bound else "(?:.*/)?") + body + ("/.*$" if glob.endswith("/") else "(?:/.*)?$")


def ignored(spark: SparkSession, root: str, nested: int = 8) -> Column:
    """Whether a path is ignored by the ignore files below root: that of the root and up to `nested` others, the last rule
    that fits a path counts. Their few lines are read on the driver."""
    out = F.lit(False)
    for folder, text in _ignore_files(spark, root, nested):
        for rule in filter(None, (ignore_rule(x, folder) for x in text.split("\n"))):
            out = F.when(F.col("path").rlike(rule[1]), F.lit(not rule[0])).otherwise(out)
    return out


def _ignore_files(spark: SparkSession, root: str, nested: int) -> list[tuple[str, str]]:
    """(folder, text) of ignore files, the root's first. Spark's readers pass over hidden files, so its file system reads them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    found = [s.getPath() for depth in range(4) for s in fs.globStatus(path(root.rstrip("/") + "/*" * depth + "/.gitignore")) or ()]
    out = []
    for p in found[: nested + 1]:
        stream = fs.open(p)
        out.append((p.getParent().toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        stream.close()
    return out


def project_of(path: Column, roots: list[str]) -> Column:
    """The longest of the roots that a path lies below."""
    by_length = sorted((r.rstrip("/") for r in roots), key=len, reverse=True)
    out = F.lit(None).cast("string")
    for r in reversed(by_length):
        out = F.when(F.startswith(path, F.lit(r + "/")), r).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, globs: tuple[str, ...] = (), max_size: int = MAX_FILE_SIZE, ignore_files: bool = True) -> DataFrame:
    """(path, size, modified, language, text) of supported, not empty, not too large files under root that no ignore file
    and none of the globs leaves out."""
    meta = F.col("_metadata")
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    files = files.select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"), F.col("value").alias("text"))
    files = files.where((F.col("size") > 0) & (F.col("size") <= max_size) & ~F.col("path").rlike("/(" + "|".join(map(re.escape, SKIPPED)) + ")/"))
    for glob in globs:
        files = files.where(~F.col("path").rlike(glob_pattern("**/" + glob)))
    if ignore_files:
        files = files.where(~ignored(spark, root))
    return files.withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL").select("path", "size", "modified", "language", "text")


def _visibility(name: str) -> str:
    return "public" if name.startswith("__") and name.endswith("__") else "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"


def python_symbols(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out, lines = [], text.split("\n")

    def walk(body, parent):
        for x in body:
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                static = any(isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod") for d in x.decorator_list)
                kind = "function" if parent is None else "constructor" if x.name == "__init__" else "method"
                out.append((kind, x.name, parent, x.lineno, x.end_lineno, lines[x.lineno - 1].strip(), isinstance(x, ast.AsyncFunctionDef), static, not x.name.startswith("_"), _visibility(x.name), ast.get_docstring(x)))
            elif isinstance(x, ast.ClassDef):
                out.append(("class", x.name, parent, x.lineno, x.end_lineno, lines[x.lineno - 1].strip(), False, False, not x.name.startswith("_"), _visibility(x.name), ast.get_docstring(x)))
                walk(x.body, x.name)
            elif isinstance(x, ast.Assign) and parent is None:
                for target in x.targets:
                    if isinstance(target, ast.Name):
                        out.append(("constant" if target.id.isupper() else "variable", target.id, None, x.lineno, x.end_lineno, lines[x.lineno - 1].strip(), False, False, not target.id.startswith("_"), _visibility(target.id), None))

    walk(tree.body, None)
    return out


def _end_line(lines: list[str], start: int) -> int:
    """Where the braces that open at a declaration are closed again; the line itself, if none opens or it ends a statement."""
    if lines[start].rstrip().endswith(";") and lines[start].count("{") == lines[start].count("}"):
        return start + 1
    depth, opened = 0, False
    for i in range(start, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened = opened or "{" in lines[i]
        if opened and depth <= 0:
            return i + 1
        if not opened and i > start + 1:
            break
    return start + 1


def pattern_symbols(language: str, text: str) -> list[tuple]:
    lines, out, owners = text.split("\n"), [], []
    rules = [(k, re.compile(p)) for k, p in DECLARATIONS.get(language, ())]
    for i, line in enumerate(lines):
        for kind, rule in rules:
            m = rule.match(line)
            if not m:
                continue
            owners = [o for o in owners if o[1] > i]
            end = _end_line(lines, i)
            name = m[1]
            if kind == "function" and owners and language in ("rust",):
                kind = "method"
            if kind == "method" and name == "constructor":
                kind = "constructor"
            exported = name[:1].isupper() if language == "go" else bool(re.match(r"\s*(export|pub|public)\b", line))
            seen = re.search(r"\b(public|private|protected)\b", line)
            comment = lines[i - 1].strip().lstrip("/#* ").rstrip("*/ ") if i and re.match(r"\s*(//|#|\*|/\*)", lines[i - 1]) else None
            out.append((kind, name, owners[-1][0] if owners else None, i + 1, end, line.strip(), bool(re.search(r"\basync\b", line)), bool(re.search(r"\bstatic\b", line)), exported, seen[1] if seen else "public", comment or None))
            if kind in ("class", "interface", "module") and end > i + 1:
                owners.append((name, end))
            break
    return out


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, text), the file itself among them."""
    names, kinds = zip(*(x.split() for x in _SYMBOLS.split(", ")), strict=True)

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not (text or "").strip():
                    continue
                rows.append((path, language, "file", path.rsplit("/", 1)[-1], None, 1, text.count("\n") + 1, path, False, False, True, "public", None))
                found = python_symbols(text) if language == "python" else pattern_symbols(language, text)
                rows += [(path, language, *x) for x in found]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, kinds, strict=True)], list(names))

    return files.select("path", "language", "text").mapInArrow(run, _SYMBOLS)


def nodes_of(found: DataFrame) -> DataFrame:
    qualified = F.when(F.col("type") == "file", F.col("path")).otherwise(F.concat_ws(".", "path", "parent", "name"))
    return found.select(node_id(F.col("path"), F.col("name"), F.col("type"), F.col("startLine")).alias("id"), "type", "name", qualified.alias("qualifiedName"), F.col("path").alias("filePath"), "startLine", "endLine", "signature", "docComment", "language", "visibility", "isAsync", "isStatic", "isExported", "parent")


def contains_edges(nodes: DataFrame) -> DataFrame:
    """From the innermost owner: the class that a member is in, else the file."""
    files = nodes.where("type = 'file'").select(F.col("id").alias("_f"), "filePath")
    owners = nodes.where("type IN ('class', 'interface', 'module')").groupBy("filePath", F.col("name").alias("parent")).agg(F.min("id").alias("_o"))
    rows = nodes.where("type <> 'file'").join(files, "filePath").join(owners, ["filePath", "parent"], "left")
    return rows.select(F.coalesce("_o", "_f").alias("sourceId"), F.col("id").alias("targetId"), F.lit("contains").alias("type")).distinct()


def _modules(pattern: str, groups) -> Column:
    """What a file's text imports, by a pattern of several groups of which one is there."""
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda h: F.coalesce(*(F.nullif(F.regexp_extract(h, pattern, g), F.lit("")) for g in groups)))


def import_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, module, target): what a file imports, and the file that this is, where a file of the tree fits."""
    modules = F.array().cast("array<string>")
    for language, pattern in IMPORTS.items():  # one pass over the files: each has one language
        whole, groups = "(?m)" + pattern, range(1, re.compile(pattern).groups + 1)
        modules = F.when(F.col("language") == language, _modules(whole, groups)).otherwise(modules)
    out = files.select("path", F.explode(modules).alias("module")).where("module IS NOT NULL").distinct()
    folder = F.regexp_replace("path", "/[^/]*$", "")
    plain = F.regexp_replace(F.regexp_replace("module", "^[.]/", ""), "[.](js|ts|jsx|tsx|py)$", "")
    tail = F.when(F.contains("module", F.lit("/")) | F.startswith("module", F.lit(".")), plain).otherwise(F.translate("module", ".", "/"))
    wanted = out.withColumn("stem", F.concat_ws("/", folder, tail))
    known = nodes.where("type = 'file'").select(F.col("id").alias("target"), F.regexp_replace(F.regexp_replace("filePath", "[.][^./]+$", ""), "/(index|__init__)$", "").alias("stem"))
    return wanted.join(known.groupBy("stem").agg(F.min("target").alias("target")), "stem", "left").select("path", "module", "target")


def inheritance(found: DataFrame) -> DataFrame:
    """(path, name, base): the bases that a class declaration names."""
    bases = F.when(F.col("language") == "python", F.split(F.regexp_extract("signature", "\\(([^)]*)\\)", 1), "\\s*,\\s*")).otherwise(
        F.flatten(F.transform(F.regexp_extract_all("signature", F.lit("(?:extends|implements)\\s+([\\w.$, ]+)"), F.lit(1)), lambda x: F.split(x, "\\s*,\\s*|\\s+implements\\s+")))
    )
    rows = found.where("type IN ('class', 'interface')").select("path", "name", F.explode(bases).alias("base"))
    return rows.select("path", "name", F.regexp_extract("base", "^\\s*([\\w.$]+)", 1).alias("base")).where("base NOT IN ('', 'object', 'ABC')").distinct()


def call_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls edges: names followed by a parenthesis within a callable's lines after its first, to all callables of that
    name; those of the same file where there are any, else those of other files (names of three letters at least)."""
    callable_ = nodes.where("type IN ('function', 'method', 'constructor')")
    lines = files.select(F.col("path").alias("filePath"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    words = lines.select("filePath", (F.col("at") + 1).alias("at"), F.explode(F.regexp_extract_all("line", F.lit("\\b([A-Za-z_$][\\w$]*)\\s*\\("), F.lit(1))).alias("called"))
    inside = callable_.select(F.col("id").alias("sourceId"), "filePath", F.col("name").alias("own"), "startLine", "endLine")
    uses = words.join(inside, "filePath").where("at > startLine AND at <= endLine AND called <> own").select("sourceId", "filePath", "called").distinct()
    targets = callable_.select(F.col("id").alias("targetId"), F.col("name").alias("called"), F.col("filePath").alias("there"))
    met = uses.join(targets, "called").where("length(called) >= 3 OR filePath = there")
    local = met.where("filePath = there").select("sourceId", "called").distinct().withColumn("_l", F.lit(True))
    out = met.join(local, ["sourceId", "called"], "left").where("_l IS NULL OR filePath = there")
    return out.select("sourceId", "targetId", F.lit("calls").alias("type")).distinct()


def index(spark: SparkSession, root: str, **options) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a source tree."""
    files = scan(spark, root, **options)
    found = symbols(files)
    nodes = nodes_of(found)
    classes = nodes.where("type IN ('class', 'interface')").groupBy("name").agg(F.min("id").alias("_id"))
    bases = inheritance(found).join(nodes.where("type IN ('class', 'interface')").select(F.col("id").alias("sourceId"), F.col("filePath").alias("path"), "name"), ["path", "name"])
    bases = bases.join(classes.withColumnRenamed("name", "base"), "base", "left").select("sourceId", F.coalesce("_id", "base").alias("targetId"), F.lit("inherits").alias("type"))
    file_ids = nodes.where("type = 'file'").select(F.col("id").alias("sourceId"), F.col("filePath").alias("path"))
    imports = import_edges(files, nodes).join(file_ids, "path").select("sourceId", F.coalesce("target", "module").alias("targetId"), F.lit("imports").alias("type"))
    return nodes, contains_edges(nodes).unionAll(bases).unionAll(imports).unionAll(call_edges(files, nodes)).distinct()


def read_lines(files: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """(line_no, line) of a file: 200 lines from start, at most 500."""
    last = min(end if end is not None else start + 199, start + 499)
    rows = files.where(F.col("path") == path).select(F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    return rows.where(F.col("line_no").between(start, last))


def containing_symbol(nodes: DataFrame, path: str, line: int) -> DataFrame:
    """The innermost symbol around a line."""
    return nodes.where((F.col("filePath") == path) & (F.col("type") != "file") & (F.col("startLine") <= line) & (F.col("endLine") >= line)).orderBy(F.col("endLine") - F.col("startLine"), "id").limit(1)
