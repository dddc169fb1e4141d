"""Binds the engine's relations to the evaluation tables. One SQL text each, for Spark and for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_NODE = "SELECT concat('{p}:', {k}) AS id, '{t}' AS type, {n} AS name, concat({f}, '.', {n}) AS qualifiedName, {f} AS filePath, CAST({k} % 97 AS INT) AS startLine, CAST({k} % 97 + {k} % 13 AS INT) AS endLine, concat('{t} ', {n}, '(', {s}, ')') AS signature, {l} AS language, CASE {k} % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'protected' ELSE 'public' END AS visibility, {k} % 5 = 0 AS isAsync, {k} % 7 = 0 AS isStatic, {k} % 3 = 0 AS isExported FROM {{{tab}}}"
_KINDS = [
    dict(p="r", k="r_regionkey", t="module", n="r_name", f="'/src/regions.ts'", s="''", l="'typescript'", tab="region"),
    dict(p="n", k="n_nationkey", t="namespace", n="n_name", f="concat('/src/region', n_regionkey, '.ts')", s="''", l="'typescript'", tab="nation"),
    dict(p="c", k="c_custkey", t="class", n="c_name", f="concat('/src/nation', c_nationkey, '.ts')", s="c_mktsegment", l="'typescript'", tab="customer"),
    dict(p="s", k="s_suppkey", t="interface", n="s_name", f="concat('/src/nation', s_nationkey, '.py')", s="''", l="'python'", tab="supplier"),
    dict(p="p", k="p_partkey", t="function", n="p_name", f="concat('/lib/', p_brand, '.go')", s="p_type", l="'go'", tab="part"),
    dict(p="o", k="o_orderkey", t="method", n="concat('order', o_orderkey)", f="concat('/test/', o_orderpriority, '.py')", s="o_orderstatus", l="'python'", tab="orders"),
]
NODES = "\nUNION ALL ".join(_NODE.format(**k) for k in _KINDS)
EDGES = """SELECT concat('r:', n_regionkey) AS sourceId, concat('n:', n_nationkey) AS targetId, 'contains' AS type FROM {nation}
UNION ALL SELECT concat('n:', c_nationkey), concat('c:', c_custkey), 'contains' FROM {customer}
UNION ALL SELECT concat('n:', s_nationkey), concat('s:', s_suppkey), 'contains' FROM {supplier}
UNION ALL SELECT DISTINCT concat('p:', l_partkey), concat('o:', l_orderkey), 'calls' FROM {lineitem}
UNION ALL SELECT concat('o:', o_orderkey), concat('c:', o_custkey), 'depends_on' FROM {orders}
UNION ALL SELECT DISTINCT concat('p:', l_partkey), concat('s:', l_suppkey), 'imports' FROM {lineitem}
UNION ALL SELECT DISTINCT concat('p:', a.l_partkey), concat('p:', b.l_partkey), 'uses' FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""

#: CTEs for the checking engine; queries go after "WITH {CTES}".
CTES = f"nodes AS ({NODES.format(**{t: t for t in TABLES})}), edges AS ({EDGES.format(**{t: t for t in TABLES})})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, NODES)


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Repeats are dropped where all edges of a source meet, in one shuffle of all kinds: what goes on by source needs no other.
    With `repeats` they stay, for what drops them itself."""
    rows = bind(spark, sf_dir, EDGES.replace("SELECT DISTINCT", "SELECT"))
    return rows if repeats else rows.repartition("sourceId").distinct()
