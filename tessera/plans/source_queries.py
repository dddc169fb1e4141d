"""Queries of source trees. The evaluation tables hold none, so a tree is derived from them: a Python file for each
supplier and a TypeScript file for each customer, in folders by nation, beside a few planted files of other languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as t
from tessera.plans.registry import query
from tessera.sources import manifests, tree

FILES = [
    ("/p/shop.py", "python", "import os\nfrom util import tax\n\nRATE = 1\n\nclass Shop(Base):\n    def __init__(self):\n        self.total = tax(1)\n\n    async def _sell(self):\n        return helper()\n\ndef helper():\n    return 1\n"),
    ("/p/util.py", "python", "def tax(x):\n    return x\n\nclass Base:\n    pass\n"),
    ("/p/app.ts", "typescript", "import { a } from './lib';\nexport class App extends Base implements Runs {\n  private run(x: number) {\n    return start(x);\n  }\n}\nexport async function start(x) {\n  return x;\n}\n"),
    ("/p/lib.ts", "typescript", "export const a = 1;\nexport interface Runs { x: number }\n"),
    ("/p/main.go", "go", "package main\n\nimport \"fmt\"\n\ntype Store struct {\n\tn int\n}\n\nfunc (s *Store) Add() {\n}\n\nfunc main() {\n}\n"),
    ("/p/x.rs", "rust", "use std::io;\npub struct P {\n}\npub fn f() {\n}\n"), ("/p/c.swift", "swift", "protocol Can {}\nfinal class Dog {\n}\n"), ("/p/q.sql", "sql", "CREATE TABLE IF NOT EXISTS t (x INT);\n"),
    ("/p/m.ex", "elixir", "defmodule A.B do\n  def go do\n  end\nend\n"),
]


_PY = ["import os", "from s{next} import make{next}", "", "LIMIT = {k}", "", "class Supplier{k}(Base{n}):", "    def __init__(self):", "        self.x = make{next}(1)", "", "    def _sell(self):", "        return make{k}(2)", "", "def make{k}(x):", "    return x", ""]
_TS = ["import {{ a }} from './c{next}';", "export class Customer{k} extends Base implements Runs {{", "  private run(x: number) {{", "    return start{k}(x);", "  }}", "}}", "export async function start{k}(x) {{", "  return x;", "}}", ""]


def _written(lines: list[str], key: str, nation: str):
    """A file's text with its own number, the next one's and its nation's in place."""
    parts = "\n".join(lines).replace("{next}", "\0n\0").replace("{k}", "\0k\0").replace("{n}", "\0t\0").replace("{{", "{").replace("}}", "}").split("\0")
    means = {"k": F.col(key).cast("string"), "n": (F.col(key) + 1).cast("string"), "t": F.col(nation).cast("string")}
    return F.concat(*(means[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def _files(spark, sf_dir):
    planted = spark.createDataFrame(FILES, "path string, language string, text string")
    path = lambda key, nation, mark, end: F.concat(F.lit(f"/{mark}"), F.col(nation).cast("string"), F.lit(f"/{mark}"), F.col(key).cast("string"), F.lit(end))
    python = t.table(spark, sf_dir, "supplier").select(path("s_suppkey", "s_nationkey", "s", ".py").alias("path"), F.lit("python").alias("language"), _written(_PY, "s_suppkey", "s_nationkey").alias("text"))
    script = t.table(spark, sf_dir, "customer").select(path("c_custkey", "c_nationkey", "c", ".ts").alias("path"), F.lit("typescript").alias("language"), _written(_TS, "c_custkey", "c_nationkey").alias("text"))
    return planted.unionAll(python).unionAll(script)


_SUP = "(SELECT s_suppkey AS k, '/s' || s_nationkey || '/s' || s_suppkey || '.py' AS path, s_nationkey AS n FROM supplier)"
_CUS = "(SELECT c_custkey AS k, '/c' || c_nationkey || '/c' || c_custkey || '.ts' AS path, c_nationkey AS n FROM customer)"


def _values(rows, columns: str) -> str:
    one = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({columns})"


@query(_values([("/a/B.TS", "typescript"), ("/a/x.py", "python"), ("/Dockerfile", "dockerfile"), ("/a/Makefile", "makefile"), ("/a/none.xyz", None), ("/a/noext", None)], "path, language")
       + " UNION ALL SELECT '/b/' || p_partkey || ['.rs', '.GO', '.none', ''][1 + p_partkey::INTEGER % 4], ['rust', 'go', NULL, NULL][1 + p_partkey::INTEGER % 4] FROM part")
def s3_languages(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in ("/a/B.TS", "/a/x.py", "/Dockerfile", "/a/Makefile", "/a/none.xyz", "/a/noext")], "path string")
    ends = F.get(F.array(*map(F.lit, (".rs", ".GO", ".none", ""))), (F.col("p_partkey") % 4).cast("int"))
    d = d.unionAll(t.table(spark, sf_dir, "part").select(F.concat(F.lit("/b/"), F.col("p_partkey").cast("string"), ends)))
    return d.select("path", tree.language_of(F.col("path")).alias("language"))


@query(_values([("/p/shop.py", "constant", "RATE", None, 4, 4), ("/p/shop.py", "class", "Shop", None, 6, 11), ("/p/shop.py", "constructor", "__init__", "Shop", 7, 8), ("/p/shop.py", "method", "_sell", "Shop", 10, 11), ("/p/shop.py", "function", "helper", None, 13, 14), ("/p/util.py", "function", "tax", None, 1, 2), ("/p/util.py", "class", "Base", None, 4, 5)], "path, type, name, parent, startLine, endLine")
       + " UNION ALL SELECT path, u.* FROM " + _SUP + ", LATERAL (VALUES ('constant', 'LIMIT', NULL, 4, 4), ('class', 'Supplier' || k, NULL, 6, 11), ('constructor', '__init__', 'Supplier' || k, 7, 8), ('method', '_sell', 'Supplier' || k, 10, 11), ('function', 'make' || k, NULL, 13, 14)) AS u(a, b, c, d, e)")
def s4_python_symbols(spark, sf_dir):
    return tree.symbols(_files(spark, sf_dir)).where("language = 'python' AND type <> 'file'").select("path", "type", "name", "parent", "startLine", "endLine")


@query(_values([("app.ts", "class", "App", True, 2, 6), ("app.ts", "method", "run", False, 3, 5), ("app.ts", "function", "start", True, 7, 9), ("lib.ts", "constant", "a", True, 1, 1), ("lib.ts", "interface", "Runs", True, 2, 2), ("main.go", "class", "Store", True, 5, 7), ("main.go", "method", "Add", True, 9, 10), ("main.go", "function", "main", False, 12, 13), ("x.rs", "class", "P", True, 2, 3), ("x.rs", "function", "f", True, 4, 5), ("c.swift", "interface", "Can", False, 1, 1), ("c.swift", "class", "Dog", False, 2, 3), ("q.sql", "class", "t", False, 1, 1), ("m.ex", "module", "A.B", False, 1, 1), ("m.ex", "function", "go", False, 2, 2)], "file, type, name, isExported, startLine, endLine")
       + " UNION ALL SELECT 'c' || k || '.ts', u.* FROM " + _CUS + ", LATERAL (VALUES ('class', 'Customer' || k, true, 2, 6), ('method', 'run', false, 3, 5), ('function', 'start' || k, true, 7, 9)) AS u(a, b, c, d, e)")
def s5_pattern_symbols(spark, sf_dir):
    return tree.symbols(_files(spark, sf_dir)).where("language <> 'python' AND type <> 'file'").select(F.substring_index("path", "/", -1).alias("file"), "type", "name", "isExported", "startLine", "endLine")


@query(_values([("/p/shop.py", "os", None), ("/p/shop.py", "util", "util.py"), ("/p/app.ts", "./lib", "lib.ts"), ("/p/main.go", "fmt", None), ("/p/x.rs", "std::io", None)], "path, module, target")
       + " UNION ALL SELECT path, 'os', NULL FROM " + _SUP + " UNION ALL SELECT x.path, 's' || (x.k + 1), CASE WHEN y.k IS NOT NULL THEN 's' || y.k || '.py' END FROM " + _SUP + " x LEFT JOIN " + _SUP + " y ON y.k = x.k + 1 AND y.n = x.n UNION ALL SELECT x.path, './c' || (x.k + 1), CASE WHEN y.k IS NOT NULL THEN 'c' || y.k || '.ts' END FROM " + _CUS + " x LEFT JOIN " + _CUS + " y ON y.k = x.k + 1 AND y.n = x.n")
def s6_imports(spark, sf_dir):
    files = _files(spark, sf_dir)
    nodes = tree.nodes_of(tree.symbols(files))
    names = nodes.where("type = 'file'").select(F.col("id").alias("target"), "name")
    return tree.import_edges(files, nodes).join(names, "target", "left").select("path", "module", F.col("name").alias("target"))


@query(_values([("/p/app.ts", "./lib"), ("/p/shop.py", "util")], "path, module")
       + " UNION ALL SELECT x.path, 's' || y.k FROM " + _SUP + " x JOIN " + _SUP + " y ON y.k = x.k + 1 AND y.n = x.n UNION ALL SELECT x.path, './c' || y.k FROM " + _CUS + " x JOIN " + _CUS + " y ON y.k = x.k + 1 AND y.n = x.n")
def j17_resolved_imports(spark, sf_dir):
    return s6_imports(spark, sf_dir).where("target IS NOT NULL").select("path", "module")


@query(_values([("Shop", "Base"), ("App", "Base"), ("App", "Runs")], "name, base")
       + " UNION ALL SELECT 'Supplier' || k, 'Base' || n FROM " + _SUP + " UNION ALL SELECT 'Customer' || k, u.base FROM " + _CUS + ", (VALUES ('Base'), ('Runs')) AS u(base)")
def s7_inheritance(spark, sf_dir):
    return tree.inheritance(tree.symbols(_files(spark, sf_dir))).select("name", "base")


def _calls(spark, sf_dir):
    files = _files(spark, sf_dir)
    nodes = tree.nodes_of(tree.symbols(files))
    a, b = (nodes.select(F.col("id").alias(x), F.col("name").alias(n), F.col("filePath").alias(f)) for x, n, f in (("sourceId", "caller", "here"), ("targetId", "callee", "there")))
    return tree.call_edges(files, nodes).join(a, "sourceId").join(b, "targetId")


@query(_values([("_sell", "helper"), ("run", "start")], "caller, callee")
       + " UNION ALL SELECT '_sell', 'make' || k FROM " + _SUP + " UNION ALL SELECT 'run', 'start' || k FROM " + _CUS)
def s8_calls_within_files(spark, sf_dir):
    return _calls(spark, sf_dir).where("here = there").select("caller", "callee")


@query(_values([("__init__", "tax")], "caller, callee")
       + " UNION ALL SELECT '__init__', 'make' || y.k FROM " + _SUP + " x JOIN " + _SUP + " y ON y.k = x.k + 1")
def j11_calls_across_files(spark, sf_dir):
    return _calls(spark, sf_dir).where("here <> there").select("caller", "callee")


@query(_values([(2, "from util import tax"), (3, ""), (4, "RATE = 1")], "line_no, line"))
def s15_line_range(spark, sf_dir):
    return tree.read_lines(_files(spark, sf_dir), "/p/shop.py", 2, 4).select("line_no", "line")


MANIFESTS = [
    ("/p/package.json", '{"dependencies": {"left": "^1.0"}, "devDependencies": {"right": "2"}}'), ("/p/requirements.txt", "# x\nflask==2.1\nnumpy"), ("/p/go.mod", "module m\nrequire github.com/a/b v1.2.3\n"),
    ("/p/Cargo.toml", '[dependencies]\nserde = "1.0"\nversion = "9"\n'), ("/p/composer.json", '{"require": {"php/x": "^8"}}'), ("/p/Gemfile", "gem 'rails', '7.0'\ngem \"puma\"\n"),
    ("/p/pyproject.toml", '[project]\ndependencies = [\n  "httpx>=0.2",\n]\n[tool.poetry.dependencies]\npython = "3.1"\nrich = "^13"\n'),
    ("/p/pom.xml", "<dependency><groupId>g</groupId>\n<artifactId>a</artifactId><version>3</version></dependency>"),
]


@query(_values([("package.json", "left", "^1.0"), ("package.json", "right", "2"), ("requirements.txt", "flask", "2.1"), ("requirements.txt", "numpy", None), ("go.mod", "github.com/a/b", "v1.2.3"), ("Cargo.toml", "serde", "1.0"), ("composer.json", "php/x", "^8"), ("Gemfile", "rails", "7.0"), ("Gemfile", "puma", None), ("pyproject.toml", "httpx", "0.2"), ("pyproject.toml", "rich", "^13"), ("pom.xml", "g:a", "3")], "file, name, version")
       + " UNION ALL SELECT 'requirements.txt', 'pkg' || s_suppkey, s_suppkey || '.0' FROM supplier")
def s18_manifests(spark, sf_dir):
    line = F.concat(F.lit("pkg"), F.col("s_suppkey").cast("string"), F.lit("=="), F.col("s_suppkey").cast("string"), F.lit(".0"))
    own = t.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "\n").alias("text"))  # a list a nation
    own = own.select(F.concat(F.lit("/n"), F.col("s_nationkey").cast("string"), F.lit("/requirements.txt")).alias("path"), "text")
    d = manifests.dependencies(spark.createDataFrame(MANIFESTS, "path string, text string").unionAll(own))
    return d.select(F.substring_index("path", "/", -1).alias("file"), "name", "version")


@query("SELECT * FROM (VALUES (1, '## Use it' || chr(10) || 'Status: active' || chr(10) || chr(10) || 'Because.' || chr(10) || 'Tags: a, b')) AS v(id, markdown)"
       + " UNION ALL SELECT (100 + p_partkey)::INTEGER, '## ' || p_name || chr(10) || 'Status: active' || chr(10) || chr(10) || p_type || chr(10) || 'Tags: ' || p_brand || ', x' FROM part")
def s21_decision_markdown(spark, sf_dir):
    d = spark.createDataFrame([(1, "Use it", "active", "Because.", ["a", "b"])], "id int, title string, status string, description string, tags array<string>")
    own = t.table(spark, sf_dir, "part").select((100 + F.col("p_partkey")).cast("int"), "p_name", F.lit("active"), "p_type", F.array(F.col("p_brand"), F.lit("x")))
    return manifests.decisions_markdown(d.unionAll(own))


@query(_values([("/a/b/x.py", "/a/b"), ("/a/c.py", "/a"), ("/z/q.py", None)], "path, root")
       + " UNION ALL SELECT '/n' || s_nationkey || '/x/' || s_suppkey || '.py', CASE WHEN s_nationkey < 5 THEN '/n' || s_nationkey END FROM supplier")
def s2_project_roots(spark, sf_dir):
    d = spark.createDataFrame([("/a/b/x.py",), ("/a/c.py",), ("/z/q.py",)], "path string")
    own = F.concat(F.lit("/n"), F.col("s_nationkey").cast("string"), F.lit("/x/"), F.col("s_suppkey").cast("string"), F.lit(".py"))
    d = d.unionAll(t.table(spark, sf_dir, "supplier").select(own))
    return d.select("path", tree.project_of(F.col("path"), ["/a", "/a/b", *(f"/n{i}" for i in range(5))]).alias("root"))


@query("""WITH n AS (SELECT DISTINCT s_nationkey AS n FROM supplier) SELECT '/n' || n AS root, 'framework' AS kind, 'Flask' AS name FROM n WHERE n % 3 = 0 UNION ALL SELECT '/n' || n, 'build tool', 'Docker' FROM n WHERE n % 2 = 0
UNION ALL SELECT '/n' || n, 'framework', 'Next.js' FROM n WHERE n % 5 = 0 UNION ALL SELECT '/p', 'build tool', unnest(['Go Modules', 'Cargo', 'Maven']) UNION ALL SELECT '/p', 'framework', unnest(['Ruby on Rails', 'Flask'])""")
def q13_frameworks(spark, sf_dir):
    """Folders of nations with marks by number, and the planted manifests."""
    nation = F.col("s_nationkey").cast("string")
    key = t.table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    own = key.select(F.concat(F.lit("/n"), nation, F.lit("/requirements.txt")).alias("path"), F.when(F.col("s_nationkey") % 3 == 0, "flask==2\nother").otherwise("other==1").alias("text"))
    texts = spark.createDataFrame(MANIFESTS, "path string, text string").unionAll(own)
    mark = lambda every, name: key.where(F.col("s_nationkey") % every == 0).select(F.concat(F.lit("/n"), nation, F.lit(f"/{name}")).alias("path"))
    paths = texts.select("path").unionAll(mark(2, "Dockerfile")).unionAll(mark(5, "next.config.js"))
    return manifests.tools_of(paths, manifests.dependencies(texts))
