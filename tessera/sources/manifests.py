"""Dependency manifests as rows (path, name, version)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def package_json(files: DataFrame) -> DataFrame:
    parts = [F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>") for k in ("dependencies", "devDependencies")]
    empty = F.create_map().cast("map<string,string>")
    entries = F.concat(*(F.map_entries(F.coalesce(p, empty)) for p in parts))
    return files.where(F.col("path").endswith("package.json")).select("path", F.explode(entries).alias("e")).select("path", F.col("e.key").alias("name"), F.col("e.value").alias("version"))


def _by_line(files: DataFrame, file_name: str, pattern: str) -> DataFrame:
    rows = files.where(F.col("path").endswith(file_name)).select("path", F.explode(F.split("text", "\n", -1)).alias("line"))
    hit = lambda g: F.regexp_extract("line", pattern, g)
    return rows.where(F.col("line").rlike(pattern)).select("path", hit(1).alias("name"), F.nullif(hit(2), F.lit("")).alias("version"))


def requirements_txt(files: DataFrame) -> DataFrame:
    return _by_line(files, "requirements.txt", "^\\s*([A-Za-z0-9._-]+)\\s*(?:[=<>~!]=?\\s*([^\\s;#]+))?")


def go_mod(files: DataFrame) -> DataFrame:
    return _by_line(files, "go.mod", "^\\s*(?:require\\s+)?([\\w.-]+\\.[\\w./-]+)\\s+(v\\S+)")


def cargo_toml(files: DataFrame) -> DataFrame:
    return _by_line(files, "Cargo.toml", "^([A-Za-z0-9_-]+)\\s*=\\s*(?:\"|\\{\\s*version\\s*=\\s*\")([0-9^~=<>*][^\"]*)\"").where("name NOT IN ('version', 'edition')")


def composer_json(files: DataFrame) -> DataFrame:
    parts = [F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>") for k in ("require", "require-dev")]
    entries = F.concat(*(F.map_entries(F.coalesce(p, F.create_map().cast("map<string,string>"))) for p in parts))
    return files.where(F.col("path").endswith("composer.json")).select("path", F.explode(entries).alias("e")).select("path", F.col("e.key").alias("name"), F.col("e.value").alias("version"))


def gemfile(files: DataFrame) -> DataFrame:
    return _by_line(files, "Gemfile", "^\\s*gem\\s+['\"]([^'\"]+)['\"](?:\\s*,\\s*['\"]([^'\"]+)['\"])?")


def pyproject_toml(files: DataFrame) -> DataFrame:
    """Quoted requirements of a list, and name = "version" lines of poetry's sections."""
    return _by_line(files, "pyproject.toml", "^\\s*['\"]([A-Za-z0-9._-]+)\\s*(?:\\[[^\\]]*\\])?\\s*[=<>~!]=?\\s*([^'\";,]+)").unionAll(
        _by_line(files, "pyproject.toml", "^([A-Za-z0-9_-]+)\\s*=\\s*['\"]([\\^~>=<]*[0-9][^'\"]*)['\"]").where("name NOT IN ('version', 'python', 'requires-python')")
    )


def pom_xml(files: DataFrame) -> DataFrame:
    parts = F.regexp_extract_all("text", F.lit("(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    rows = files.where(F.col("path").endswith("pom.xml")).select("path", F.explode(parts).alias("d"))
    tag = lambda t: F.regexp_extract("d", f"<{t}>\\s*([^<\\s]+)", 1)
    return rows.select("path", F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), F.nullif(tag("version"), F.lit("")).alias("version"))


MANIFESTS = (package_json, requirements_txt, go_mod, cargo_toml, composer_json, gemfile, pyproject_toml, pom_xml)


def dependencies(files: DataFrame) -> DataFrame:
    """(path, name, version) of all manifests among files (path, text)."""
    return reduce(DataFrame.unionAll, (m(files) for m in MANIFESTS))


# --- shared files and exports


def write_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON lines in order, in one file where they fit: what two sides share."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def memories_json(memories: DataFrame) -> DataFrame:
    """(id, json) of notes."""
    return memories.select("id", F.to_json(F.struct(*memories.columns)).alias("json"))


def decisions_markdown(decisions: DataFrame) -> DataFrame:
    """(id, markdown): a section for each decision."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\nTags: "), F.array_join("tags", ", "))).otherwise("")
    return decisions.select("id", F.concat(F.lit("## "), "title", F.lit("\nStatus: "), "status", F.lit("\n\n"), "description", tags).alias("markdown"))


# Frameworks and build tools, each with the files and the dependencies that mark it.
MARKS = (
    ("framework", "Next.js", ("next.config.js", "next.config.ts", "next.config.mjs"), ("next",)),
    ("framework", "Nuxt.js", ("nuxt.config.ts", "nuxt.config.js"), ("nuxt",)),
    ("framework", "Angular", ("angular.json",), ("@angular/core",)),
    ("framework", "Vite", ("vite.config.ts", "vite.config.js"), ("vite",)),
    ("framework", "React", (), ("react", "react-dom")),
    ("framework", "Vue.js", (), ("vue",)),
    ("framework", "Svelte", (), ("svelte",)),
    ("framework", "Express.js", (), ("express",)),
    ("framework", "Fastify", (), ("fastify",)),
    ("framework", "Koa", (), ("koa",)),
    ("framework", "NestJS", (), ("nestjs", "@nestjs/core")),
    ("framework", "Electron", (), ("electron",)),
    ("framework", "Django", (), ("django",)),
    ("framework", "Flask", (), ("flask",)),
    ("framework", "FastAPI", (), ("fastapi",)),
    ("framework", "Ruby on Rails", ("Gemfile",), ("rails",)),
    ("framework", "Spring Boot", (), ("spring-boot", "spring-core")),
    ("framework", "WPF", (), ("wpf", "WindowsBase")),
    ("framework", "Xamarin", (), ("Xamarin.Forms",)),
    ("framework", ".NET MAUI", (), ("MAUI", "Microsoft.Maui")),
    ("build tool", "Webpack", ("webpack.config.js", "webpack.config.ts"), ()),
    ("build tool", "Rollup", ("rollup.config.js", "rollup.config.ts"), ()),
    ("build tool", "esbuild", ("esbuild.config.js",), ()),
    ("build tool", "TypeScript", ("tsconfig.json",), ()),
    ("build tool", "Babel", ("babel.config.js", ".babelrc"), ()),
    ("build tool", "Make", ("Makefile",), ()),
    ("build tool", "CMake", ("CMakeLists.txt",), ()),
    ("build tool", "Gradle", ("build.gradle", "build.gradle.kts"), ()),
    ("build tool", "Maven", ("pom.xml",), ()),
    ("build tool", "Cargo", ("Cargo.toml",), ()),
    ("build tool", "Go Modules", ("go.mod",), ()),
    ("build tool", "Docker", ("Dockerfile",), ()),
    ("build tool", "Docker Compose", ("docker-compose.yml", "docker-compose.yaml"), ()),
)


def tools_of(paths: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(root, kind, name): frameworks and build tools of each folder, by its files (path) and by what its manifests (path,
    name) depend on. The marks are a small table that joins by name."""
    spark = paths.sparkSession
    marks = spark.createDataFrame([(k, n, f"file:{x}") for k, n, files, _ in MARKS for x in files] + [(k, n, f"dep:{x}") for k, n, _, deps in MARKS for x in deps], "kind string, name string, mark string")
    root = F.regexp_replace("path", "/[^/]*$", "")
    files = paths.select(root.alias("root"), F.concat(F.lit("file:"), F.element_at(F.split("path", "/"), -1)).alias("mark"))
    needs = dependencies.select(root.alias("root"), F.concat(F.lit("dep:"), "name").alias("mark"))
    return files.unionAll(needs).join(F.broadcast(marks), "mark").select("root", "kind", "name").distinct()
