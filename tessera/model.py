"""Schemas and closed domains of the symbol graph and of what hangs on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
PARAMETER = T.StructType([T.StructField("name", _S), T.StructField("type", _S), T.StructField("defaultValue", _S), T.StructField("isOptional", _B), T.StructField("isRest", _B)])
NODE = T.StructType(
    [T.StructField(n, t) for n, t in (("id", _S), ("type", _S), ("name", _S), ("qualifiedName", _S), ("filePath", _S), ("startLine", _I), ("endLine", _I), ("signature", _S), ("docComment", _S), ("hash", _S), ("language", _S), ("visibility", _S), ("isAsync", _B), ("isStatic", _B), ("isExported", _B), ("parameters", T.ArrayType(PARAMETER)), ("returnType", _S), ("updatedAt", T.TimestampType()))]
)
EDGE = T.StructType([T.StructField("sourceId", _S), T.StructField("targetId", _S), T.StructField("type", _S), T.StructField("metadata", T.MapType(_S, _S))])
MEMORY = T.StructType([T.StructField("id", _L), T.StructField("category", _S), T.StructField("content", _S), T.StructField("importance", _D), T.StructField("tags", T.ArrayType(_S)), T.StructField("related_files", T.ArrayType(_S)), T.StructField("created_at", T.TimestampType()), T.StructField("last_accessed_at", T.TimestampType()), T.StructField("access_count", _L)])

# The closed domains, and constants that results depend on.
NODE_TYPES = ("file", "module", "namespace", "class", "interface", "type_alias", "enum", "function", "method", "constructor", "property", "variable", "constant", "decorator", "route", "component", "hook", "test", "config")
EDGE_TYPES = ("imports", "exports", "calls", "inherits", "implements", "uses", "decorates", "overrides", "contains", "tests", "depends_on", "routes_to")
EDGE_WEIGHTS = {"calls": 1.0, "imports": 0.8, "exports": 0.6, "inherits": 1.2, "implements": 1.1, "uses": 0.7, "decorates": 0.5, "overrides": 1.0, "contains": 0.9, "tests": 0.6, "depends_on": 0.8, "routes_to": 0.7}
DEFAULT_EDGE_WEIGHT = 0.5
DEPENDENCY_TYPES = ("calls", "imports", "inherits", "implements", "uses", "depends_on")
CATEGORY_IMPORTANCE = {"architecture": 0.9, "gotcha": 0.85, "convention": 0.8, "decision": 0.8, "lesson_learned": 0.75, "dependency": 0.7, "workflow": 0.7, "context": 0.6, "preference": 0.55, "todo": 0.5}


def node_id(path: Column, name: Column, kind: Column, line: Column) -> Column:
    """First 16 hex digits of SHA-256 over file::name::type::line."""
    return F.substring(F.sha2(F.concat_ws("::", path, name, kind, line.cast("string")), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))
