"""Queries of rule tables joined with texts, paths and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as t
from tessera.operators import memory, rules
from tessera.plans.registry import query

_PATH = "^https?://[^/]+(/.*)$"
_SYMBOL = '(?:id|class)="([^"]+)"'

#: Marks in texts, as signals; each counts as a vote of 3.
TEXT_SIGNALS = (
    ("legal", "content", [r"(?i)licensed under", r"\bMIT License\b", r"All rights reserved"]),
    ("address", "content", [r"[\w.+-]+@[\w-]+\.[a-z]{2,}"]),
    ("number", "content", [r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{3,4}\b", r"\+\d[\d ().-]{8,}\d"]),
    ("secret", "content", [r"AKIA[0-9A-Z]{16}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", r"(?i)password\s*[:=]"]),
    ("link", "content", [r"https?://\w"]),
    ("junk", "content", [r"###\s\w+###", r"[$]{3}|[%]{3}"]),
    ("source of a 7", "path", [r"7/"]),
)


def _pages(spark, sf_dir):
    symbols = F.array_distinct(F.regexp_extract_all("html", F.lit(_SYMBOL), F.lit(1)))
    return t.table(spark, sf_dir, "pages").select(F.regexp_extract("url", _PATH, 1).alias("path"), F.col("html").alias("text"), symbols.alias("symbols"))


def _documents(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text", F.array().cast("array<string>").alias("symbols"))


_PAGES_SQL = f"SELECT regexp_extract(url, '{_PATH}', 1) AS path, html AS text, list_distinct(regexp_extract_all(html, '{_SYMBOL}', 1)) AS symbols FROM pages"
_DOCUMENTS_SQL = "SELECT concat_ws('/', source, doc_id) AS path, text, []::VARCHAR[] AS symbols FROM documents"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _hits_sql(files: str, signals, more: tuple = ()) -> str:
    """SQL of (path, rule, layer, weight, place): every pattern is tried on every file."""
    rows = [(f"{layer}:{kind}", kind, layer, rules.WEIGHTS[kind], p, k) for k, (layer, kind, patterns) in enumerate(signals) for p in patterns]
    rows += [(f"learned:{name}", "any", target, weight, f"(?im){p}", 1_000_000) for name, p, target, weight in more]
    values = ", ".join(f"({_text(r)}, {_text(s)}, {_text(y)}, {w}, {_text(p)}, {k})" for r, s, y, w, p, k in rows)
    base = "regexp_extract(path, '[^/]*$')"
    hit = f"""CASE source WHEN 'content' THEN regexp_matches(text, pattern) WHEN 'import' THEN regexp_matches(text, pattern) WHEN 'path' THEN regexp_matches(path, pattern) OR regexp_matches({base}, pattern)
    WHEN 'directory' THEN regexp_matches(path, pattern) WHEN 'symbol' THEN len(list_filter(symbols, lambda x: x <> '' AND regexp_matches(x, pattern))) > 0 ELSE regexp_matches(path, pattern) OR regexp_matches({base}, pattern) OR regexp_matches(text, pattern) END"""
    return f"SELECT DISTINCT path, rule, layer, weight, place FROM ({files}), (VALUES {values}) AS r(rule, source, layer, weight, pattern, place) WHERE {hit}"


_ALL_FILES = f"SELECT 'pages' AS tab, * FROM ({_hits_sql(_PAGES_SQL, rules.SIGNALS + TEXT_SIGNALS)}) UNION ALL SELECT 'documents', * FROM ({_hits_sql(_DOCUMENTS_SQL, rules.SIGNALS + TEXT_SIGNALS)})"


@query(f"SELECT tab, path, rule FROM ({_ALL_FILES})")
def j18_rule_hits(spark, sf_dir):
    table = rules.signal_rules(spark, rules.SIGNALS + TEXT_SIGNALS)
    hits = lambda files, name: rules.rule_hits(files, table).select(F.lit(name).alias("tab"), "path", "rule").distinct()
    return hits(_pages(spark, sf_dir), "pages").unionAll(hits(_documents(spark, sf_dir), "documents"))


#: Taught rules (name, pattern, target, weight); one isn't valid and is left out.
TAUGHT = (("ads", r'class="ad"', "advertising", 5), ("tracked", "track[(]0", "analytics", 2), ("english", "lang=.en.", "locale", 1), ("broken", "(", "nothing", 5))
_VALID = tuple(r for r in TAUGHT if rules.valid(r[1]))


def _taught(spark):
    rows = [("layer", n, p, target, w, 0) for n, p, target, w in TAUGHT]
    return spark.createDataFrame(rows, "kind string, name string, pattern string, target string, weight int, used long")


def _votes_sql(hits: str) -> str:
    return f"""h AS ({hits}), v AS (SELECT path, layer, sum(weight) AS score, min({{'p': place, 'r': rule}}) AS first FROM h GROUP BY path, layer),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, first) AS r, sum(score) OVER (PARTITION BY path) AS total FROM v),
w AS (SELECT path, max(layer) FILTER (r = 1) AS layer, max(floor(100 * score / total + 0.5)::INTEGER) FILTER (r = 1) AS confidence, max(layer) FILTER (r = 2) AS runner_up FROM r GROUP BY path)"""


@query(f"WITH {_votes_sql(_hits_sql(_PAGES_SQL, rules.SIGNALS, _VALID))} SELECT path, coalesce(layer, 'unknown') AS layer, coalesce(confidence, 0) AS confidence, runner_up FROM (SELECT DISTINCT path FROM ({_PAGES_SQL})) LEFT JOIN w USING (path)")
def q9_layers_by_signals(spark, sf_dir):
    """Votes of texts, paths, directories, imports and symbols, and of taught rules."""
    files = _pages(spark, sf_dir)
    table = rules.signal_rules(spark).unionAll(rules.taught_rules(_taught(spark)))
    return rules.classified(files, rules.rule_hits(files, table))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""SELECT name, target, weight, used FROM (SELECT 'item ' || item_id AS name, 'benchmark' AS target, 1 + item_id::INTEGER % 5 AS weight,
  (SELECT count(DISTINCT concat_ws('/', source, doc_id)) FROM documents d WHERE contains({_LOW.format("d.text")}, {_LOW.format("left(b.text, 60)")})) AS used FROM benchmark b WHERE text <> '')""")
def r1_rules_taught_from_benchmark(spark, sf_dir):
    """A rule for how each benchmark text begins, and the number of documents that use it."""
    b = t.table(spark, sf_dir, "benchmark").where("text <> ''")
    pattern = F.regexp_replace(F.left("text", F.lit(60)), r"([^A-Za-z0-9])", r"\\$1")
    taught = b.select(F.lit("layer").alias("kind"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), pattern.alias("pattern"), F.lit("benchmark").alias("target"), (1 + F.col("item_id").cast("int") % 5).cast("int").alias("weight"), F.lit(0).cast("long").alias("used"))
    hits = rules.rule_hits(_documents(spark, sf_dir), rules.taught_rules(taught))
    return memory.touched(taught, rules.rule_uses(hits)).select("name", "target", "weight", "used")
