"""A read-only graph query language, an openCypher subset, compiled to DataFrame plans.

The text is tokenised, parsed by recursive descent to small tuples, checked against the node and edge schema, and
planned as joins of edges and nodes; Catalyst orders and pushes down. Nothing runs before the caller asks for rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import EDGE_TYPES, NODE_TYPES

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>-?\d+(?:\.\d+)?)|(?P<id>[A-Za-z_]\w*)|(?P<op><-|->|<=|>=|<>|[-()\[\]{}:,.*=<>]))")
_WRITES = {"CREATE", "MERGE", "DELETE", "SET", "REMOVE", "DETACH", "DROP", "CALL"}
_EDGE_PROPS = ("type", "sourceId", "targetId")


class CypherError(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at position {at}")
        self.position = at


@dataclass
class Query:
    nodes: list[tuple[str | None, str | None]] = field(default_factory=list)
    hops: list[tuple[str | None, str | None, str]] = field(default_factory=list)  # variable, type, direction
    where: tuple | None = None
    distinct: bool = False
    items: list[tuple[str, str, str]] = field(default_factory=list)  # variable, property or *, alias
    order: list[tuple[str, str, bool]] = field(default_factory=list)
    limit: int | None = None


class _Parser:
    def __init__(self, text: str, strict: bool):
        self.text, self.strict, self.tokens, at = text, strict, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected character {text[at:].lstrip()[:1]!r}", at)
            kind = m.lastgroup
            if kind == "num" and m["num"][0] == "-" and self.tokens and self.tokens[-1][1] not in ("=", "<>", "<", ">", "<=", ">=", "[", ","):
                m = re.compile(r"\s*(?P<op>-)").match(text, at)
                kind = "op"
            self.tokens.append((kind, m[kind], m.start(kind)))
            at = m.end()
        self.i = 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else ("end", "", len(self.text))

    def is_word(self, *words: str) -> bool:
        return all(self.peek(k)[0] == "id" and self.peek(k)[1].upper() == w for k, w in enumerate(words))

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v, at = self.peek()
        if (kind and k != kind) or (value and (v.upper() if k == "id" else v) != value):
            raise CypherError(f"expected {value or kind}, found {v or 'the end'!r}", at)
        if k == "id" and v.upper() in _WRITES:
            raise CypherError(f"{v.upper()} is not allowed in a read-only query", at)
        self.i += 1
        return v

    def has(self, value: str) -> bool:
        k, v, _ = self.peek()
        if k != "str" and (v.upper() if k == "id" else v) == value:
            self.i += 1
            return True
        return False

    def parse(self) -> Query:
        q = Query()
        self.take("MATCH")
        q.nodes.append(self.node())
        while self.peek()[1] in ("-", "<-", "->"):
            q.hops.append(self.hop())
            q.nodes.append(self.node())
        if self.has("WHERE"):
            q.where = self.either()
        self.take("RETURN")
        q.distinct = self.has("DISTINCT")
        q.items = self.commas(self.item)
        if self.has("ORDER"):
            self.take("BY")
            q.order = self.commas(self.order)
        if self.has("LIMIT"):
            q.limit = int(self.take(kind="num"))
        if self.peek()[0] != "end":
            raise CypherError(f"unexpected {self.peek()[1]!r}", self.peek()[2])
        return q

    def commas(self, one):
        out = [one()]
        while self.has(","):
            out.append(one())
        return out

    def node(self):
        self.take("(")
        var = self.take(kind="id") if self.peek()[0] == "id" else None
        label = self.take(kind="id") if self.has(":") else None
        self.take(")")
        return var, label

    def hop(self):
        left = self.has("<-")
        if not left:
            self.take("-")
        var = kind = None
        if self.has("["):
            if self.peek()[0] == "id":
                at = self.peek()[2]
                var = self.take(kind="id")
                if self.strict and self.peek()[1] == ":":
                    raise CypherError("a typed relation cannot have a variable", at)
            if self.has(":"):
                kind = self.take(kind="id")
            self.take("]")
        if left:
            self.take("-")
            return var, kind, "in"
        return var, kind, "out" if self.has("->") else (self.has("-"), "both")[1]

    def either(self):
        out = self.both()
        while self.has("OR"):
            out = ("or", out, self.both())
        return out

    def both(self):
        out = self.primary()
        while self.has("AND"):
            out = ("and", out, self.primary())
        return out

    def primary(self):
        if self.is_word("NOT", "EXISTS"):
            self.i += 2
            self.take("{")
            self.take("(")
            var = self.take(kind="id")
            self.take(")")
            _, kind, way = self.hop()
            self.take("(")
            self.take(")")
            self.take("}")
            return ("absent", var, kind, way)
        if self.has("NOT"):
            return ("not", self.primary())
        if self.has("("):
            out = self.either()
            self.take(")")
            return out
        var, prop = self.ref()
        if self.has("IN"):
            self.take("[")
            values = [] if self.peek()[1] == "]" else self.commas(self.literal)
            self.take("]")
            return ("in", var, prop, values)
        for words in (("CONTAINS",), ("STARTS", "WITH"), ("ENDS", "WITH")):
            if self.is_word(*words):
                self.i += len(words)
                return (words[0].lower(), var, prop, self.literal())
        k, op, at = self.peek()
        if op not in ("=", "<>", "<", ">", "<=", ">="):
            raise CypherError(f"expected a comparison, found {op!r}", at)
        self.i += 1
        return ("compare", var, prop, op, self.literal())

    def ref(self):
        var = self.take(kind="id")
        self.take(".")
        return var, self.take(kind="id")

    def literal(self):
        k, v, at = self.peek()
        self.i += 1
        if k == "str":
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        if k == "num":
            return float(v) if "." in v else int(v)
        if k == "id" and v.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[v.lower()]
        raise CypherError(f"expected a literal, found {v!r}", at)

    def item(self):
        var = self.take(kind="id")
        self.take(".")
        if self.has("*"):
            return var, "*", ""
        prop = self.take(kind="id")
        return var, prop, self.take(kind="id") if self.has("AS") else f"{var}_{prop}"

    def order(self):
        var, prop = self.ref()
        down = self.has("DESC")
        if not down:
            self.has("ASC")
        return var, prop, down


def parse(text: str, strict: bool = False) -> Query:
    return _Parser(text, strict).parse()


class _Planner:
    def __init__(self, q: Query, nodes: DataFrame, edges: DataFrame):
        self.q, self.nodes, self.edges = q, nodes, edges
        self.node_vars = {v: i for i, (v, _) in enumerate(q.nodes) if v}  # a name used again is bound anew
        self.edge_vars = {v: i for i, (v, _, _) in enumerate(q.hops) if v}
        self.props = [c for c in nodes.columns]

    def column(self, var: str, prop: str) -> Column:
        if var in self.node_vars:
            if prop not in self.props:
                raise CypherError(f"unknown property {prop!r}", 0)
            return F.col(f"n{self.node_vars[var]}.{prop}")
        if var in self.edge_vars:
            if prop not in _EDGE_PROPS:
                raise CypherError(f"unknown property {prop!r} of a relation", 0)
            return F.col(f"e{self.edge_vars[var]}.{prop}")
        raise CypherError(f"unknown variable {var!r}", 0)

    def label(self, name: str | None) -> Column | None:
        if name is None:
            return None
        known = {t.replace("_", ""): t for t in NODE_TYPES}
        if name.lower().replace("_", "") not in known:
            raise CypherError(f"unknown label {name!r}", 0)
        return F.col("type") == known[name.lower().replace("_", "")]

    def kind(self, name: str | None) -> Column | None:
        if name is None:
            return None
        known = {t.replace("_", ""): t for t in EDGE_TYPES}
        if name.lower().replace("_", "") not in known:
            raise CypherError(f"unknown relation type {name!r}", 0)
        return F.col("type") == known[name.lower().replace("_", "")]

    def side(self, i: int) -> DataFrame:
        cond = self.label(self.q.nodes[i][1])
        return (self.nodes if cond is None else self.nodes.where(cond)).select(F.col("id").alias(f"id{i}"), F.struct(*self.props).alias(f"n{i}"))

    def pattern(self) -> DataFrame:
        out = self.side(0)
        for i, (_, kind, way) in enumerate(self.q.hops):
            cond = self.kind(kind)
            e = self.edges if cond is None else self.edges.where(cond)
            ends = lambda a, b, e=e, i=i: e.select(F.col(a).alias(f"id{i}"), F.col(b).alias(f"id{i + 1}"), F.struct(*_EDGE_PROPS).alias(f"e{i}"))
            if way == "out":
                hop = ends("sourceId", "targetId")
            elif way == "in":
                hop = ends("targetId", "sourceId")
            else:  # both directions as equi-joins; a loop matches once
                hop = ends("sourceId", "targetId").union(ends("targetId", "sourceId").where(f"id{i} <> id{i + 1}"))
            out = out.join(hop, f"id{i}").join(self.side(i + 1), f"id{i + 1}")
        return out

    def predicate(self, x: tuple) -> Column:
        if x[0] in ("and", "or"):
            a, b = self.predicate(x[1]), self.predicate(x[2])
            return a & b if x[0] == "and" else a | b
        if x[0] == "not":
            return ~self.predicate(x[1])
        if x[0] == "in":
            return self.column(x[1], x[2]).isin(*x[3]) if x[3] else F.lit(False)
        if x[0] in ("contains", "starts", "ends"):
            c, v = F.lower(self.column(x[1], x[2])), F.lit(str(x[3]).lower())
            return {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[x[0]](c, v)
        if x[0] == "absent":
            return F.col(self.flag(x)).isNull()
        c, v = self.column(x[1], x[2]), F.lit(x[4])
        return {"=": c == v, "<>": c != v, "<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[x[3]]

    def flag(self, x: tuple) -> str:
        return f"absent_{x[1]}_{x[2] or ''}_{x[3]}"

    def ends_of(self, x: tuple) -> DataFrame:
        if x[1] not in self.node_vars:
            raise CypherError(f"unknown variable {x[1]!r}", 0)
        cond = self.kind(x[2])
        e = self.edges if cond is None else self.edges.where(cond)
        return e.select(F.col("targetId" if x[3] == "in" else "sourceId").alias("_end")).distinct()

    def filtered(self, rows: DataFrame) -> DataFrame:
        conjuncts, rest = [], [self.q.where] if self.q.where else []
        while rest:
            x = rest.pop()
            if x[0] == "and":
                rest += [x[2], x[1]]
            else:
                conjuncts.append(x)
        for x in conjuncts:
            if x[0] == "absent":
                rows = rows.join(self.ends_of(x), F.col(f"id{self.node_vars[x[1]]}") == F.col("_end"), "left_anti")
            else:
                for y in _absences(x):  # under OR or NOT: an outer join's mark
                    if self.flag(y) not in rows.columns:
                        marks = self.ends_of(y).withColumn(self.flag(y), F.lit(True)).withColumnRenamed("_end", f"_{self.flag(y)}")
                        rows = rows.join(marks, F.col(f"id{self.node_vars[y[1]]}") == F.col(f"_{self.flag(y)}"), "left")
                rows = rows.where(self.predicate(x))
        return rows

    def plan(self) -> DataFrame:
        rows = self.filtered(self.pattern())
        out: list[Column] = []
        for var, prop, alias in self.q.items:
            if prop == "*":
                out += [self.column(var, p).alias(f"{var}_{p}") for p in (self.props if var in self.node_vars else _EDGE_PROPS)]
            else:
                out.append(self.column(var, prop).alias(alias))
        keys = [self.column(v, p).alias(f"_o{i}") for i, (v, p, _) in enumerate(self.q.order)]
        rows = rows.select(*out, *keys)
        visible = [c for c in rows.columns if not re.fullmatch(r"_o\d+", c)]
        if self.q.distinct:
            rows = rows.groupBy(*visible).agg(*(F.min(f"_o{i}").alias(f"_o{i}") for i in range(len(keys)))) if keys else rows.distinct()
        if keys:
            rows = rows.orderBy(*(F.col(f"_o{i}").desc() if down else F.col(f"_o{i}").asc() for i, (_, _, down) in enumerate(self.q.order)))
        return (rows if self.q.limit is None else rows.limit(self.q.limit)).select(*visible)


def _absences(x: tuple) -> list[tuple]:
    return [x] if x[0] == "absent" else reduce(list.__add__, (_absences(y) for y in x[1:] if isinstance(y, tuple)), [])


def run(text: str, nodes: DataFrame, edges: DataFrame, project: str | None = None, strict: bool = False) -> DataFrame:
    """The rows of a query. project: only where the first node's file path, if that node has a name, starts so."""
    q = parse(text, strict)
    if project and q.nodes[0][0]:
        scope = ("starts", q.nodes[0][0], "filePath", project)
        q.where = ("and", q.where, scope) if q.where else scope
    return _Planner(q, nodes, edges).plan()
