"""Full-text search over stored postings.

An index is two tables: postings (doc, term, one count for each field) and lengths (doc, n). They are made once and
written in ranges of the term, so that a query reads the row groups of its own terms only. Matching, ranking and the
query forms (all words, any word, prefixes) are joins and aggregations on them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.text import B, K1, words
from tessera.session import cut

# Characters of a text that the content index reads; weights of fields of notes, decisions and changes; of
# symbols as meant, and as the reference form of the ranking effectively applies them.
CONTENT_CHARS = 51_200
NOTE_WEIGHTS = {"content": 10.0, "category": 5.0, "tags": 2.0}
DECISION_WEIGHTS = {"title": 10.0, "description": 5.0, "rationale": 5.0, "tags": 2.0}
CHANGE_WEIGHTS = {"path": 1.0, "summary": 2.0, "symbols": 1.5}
SYMBOL_WEIGHTS = {"name": 10.0, "qualifiedName": 5.0, "signature": 3.0, "docComment": 1.0}
SYMBOL_WEIGHTS_COMPAT = {"name": 5.0, "qualifiedName": 3.0, "signature": 1.0, "docComment": 1.0}


# --- words


def unicode_words(text: Column) -> Column:
    """Runs of letters and digits of any script in lower case, accents off."""
    plain = F.regexp_replace(F.call_function("lower", _decomposed(text)), r"\p{M}+", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _decomposed(text: Column) -> Column:
    # Latin letters with one accent, which is what a one-character table can take apart
    return F.translate(text, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")


def camel_words(query: str) -> list[str]:
    """Words of a query: camel case split, marks as blanks, lower case."""
    import re

    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query))
    return [w.lower() for w in re.findall(r"[A-Za-z0-9]+", spaced)]


class _Stemmer:
    """The suffix-stripping algorithm of M. F. Porter (1980)."""

    @staticmethod
    def _is_consonant(w: str, i: int) -> bool:
        if w[i] in "aeiou":
            return False
        return i == 0 or not _Stemmer._is_consonant(w, i - 1) if w[i] == "y" else True

    def _measure(self, w: str) -> int:
        marks = "".join("c" if self._is_consonant(w, i) else "v" for i in range(len(w)))
        return sum(a == "v" and b == "c" for a, b in zip(marks, marks[1:], strict=False))

    def _vowel(self, w: str) -> bool:
        return any(not self._is_consonant(w, i) for i in range(len(w)))

    def _double(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and self._is_consonant(w, len(w) - 1)

    def _cvc(self, w: str) -> bool:
        n = len(w)
        return n > 2 and self._is_consonant(w, n - 3) and not self._is_consonant(w, n - 2) and self._is_consonant(w, n - 1) and w[-1] not in "wxy"

    def _swap(self, w: str, rules, least: int) -> str:
        for old, new in rules:
            if w.endswith(old):
                stem = w[: len(w) - len(old)]
                return stem + new if self._measure(stem) > least else w
        return w

    def __call__(self, w: str) -> str:
        if len(w) <= 2 or not w.isascii():
            return w
        for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(old):
                w = w[: len(w) - len(old)] + new
                break
        if w.endswith("eed"):
            w = w[:-1] if self._measure(w[:-3]) > 0 else w
        else:
            for old in ("ed", "ing"):
                if w.endswith(old) and self._vowel(w[: -len(old)]):
                    w = w[: -len(old)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self._double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self._measure(w) == 1 and self._cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and self._vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self._swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
        w = self._swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
        if w.endswith("ion"):
            w = w[:-3] if self._measure(w[:-3]) > 1 and w[-4:-3] in ("s", "t") else w
        else:
            w = self._swap(w, tuple((x, "") for x in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")), 1)
        if w.endswith("e"):
            m = self._measure(w[:-1])
            if m > 1 or (m == 1 and not self._cvc(w[:-1])):
                w = w[:-1]
        return w[:-1] if self._double(w) and w[-1] == "l" and self._measure(w) > 1 else w


_stemmed = lru_cache(100_000)(_Stemmer())


def stem(word: str) -> str:
    return _stemmed(word)


@F.pandas_udf(T.StringType())
def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(stem, na_action="ignore")


# --- the index


@dataclass
class Index:
    """postings (doc, term, <field>..) and lengths (doc, n): tokens of a document over all fields. docs and tokens (an array
    for each field) are what it was made of."""

    postings: DataFrame
    lengths: DataFrame
    fields: list[str]
    stemmed: bool = False
    docs: DataFrame | None = None
    tokens: dict[str, Column] | None = None

    def save(self, path: str) -> None:
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def load(cls, spark: SparkSession, path: str, stemmed: bool = False) -> Index:
        postings = spark.read.parquet(f"{path}/postings")
        return cls(postings, spark.read.parquet(f"{path}/lengths"), [c for c in postings.columns if c not in ("doc", "term")], stemmed)

    def scores(self, terms: list[str], weights: dict[str, float] | None = None, mode: str = "all") -> DataFrame:
        return ranked(self, terms, weights, mode)

    def replace(self, other: Index) -> Index:
        """With the documents of `other` in place of those with the same doc."""
        ids = other.lengths.select("doc")
        return Index(*(a.join(ids, "doc", "left_anti").unionByName(b) for a, b in ((self.postings, other.postings), (self.lengths, other.lengths))), self.fields, self.stemmed)


def _tagged(field: int):
    return lambda t: F.struct(F.lit(field).alias("field"), t.alias("term"))


def index(docs: DataFrame, fields: dict[str, Column], stemmed: bool = False) -> Index:
    """The index of docs (doc, ..) by arrays of tokens. Stems are made once for each distinct term, not for each token."""
    rows = docs.select("doc", *(F.coalesce(c, F.array().cast("array<string>")).alias(f"_{f}") for f, c in fields.items()))
    lengths = rows.select("doc", reduce(lambda a, b: a + b, (F.size(f"_{f}") for f in fields)).alias("n"))
    tokens = F.flatten(F.array(*(F.transform(f"_{f}", _tagged(i)) for i, f in enumerate(fields))))
    rows = rows.select("doc", F.explode(tokens).alias("t")).select("doc", "t.*")
    counts = [F.count_if(F.col("field") == i).alias(f) for i, f in enumerate(fields)]
    postings = rows.groupBy("doc", "term").agg(*counts)
    if stemmed:
        known = postings.select("term").distinct().select("term", _stems("term").alias("_stem"))
        postings = postings.join(known, "term").groupBy("doc", F.col("_stem").alias("term")).agg(*(F.sum(f).alias(f) for f in fields))
    return Index(postings, lengths, list(fields), stemmed, docs, fields)


def content_index(files: DataFrame, chars: int = CONTENT_CHARS) -> Index:
    """Of files (doc, text): their first `chars` characters, as the content search reads them (a feature of it)."""
    return index(files, {"text": words(F.substring("text", 1, chars))})


def note_index(notes: DataFrame) -> Index:
    """Of notes (doc, content, category, tags), by stems."""
    return index(notes, {"content": unicode_words(F.col("content")), "category": unicode_words(F.col("category")), "tags": unicode_words(F.array_join("tags", " "))}, stemmed=True)


def matches(ix: Index, terms: list[str], mode: str = "all") -> DataFrame:
    """(doc, term, fields..) of the postings that a query means. mode: all, any, or prefix (any word that starts so)."""
    terms = list(dict.fromkeys(stem(t) for t in terms) if ix.stemmed and mode != "prefix" else dict.fromkeys(terms))
    if not terms:
        return ix.postings.where(F.lit(False))
    if mode == "prefix":
        by = F.filter(F.array(*map(F.lit, terms)), lambda t: F.startswith(F.col("term"), t))
        starts = reduce(lambda a, b: a | b, (F.startswith(F.col("term"), F.lit(t)) for t in terms))
        rows = ix.postings.where(starts).select("doc", F.explode(by).alias("term"), *ix.fields)
        return rows.groupBy("doc", "term").agg(*(F.sum(f).alias(f) for f in ix.fields))
    hits = ix.postings.where(F.col("term").isin(terms))
    if mode == "all" and len(terms) > 1:
        whole = hits.groupBy("doc").agg(F.count("*").alias("_n")).where(F.col("_n") == len(terms)).select("doc")
        hits = hits.join(whole, "doc")
    return hits


def ranked(ix: Index, terms: list[str], weights: dict[str, float] | None = None, mode: str = "all") -> DataFrame:
    """(doc, score), higher is better: BM25 with the fields' counts summed by weight, k1 1.2, b 0.75, and an idf of
    ln((N - df + 0.5) / (df + 0.5)), at least a millionth. df counts all documents with a word, matching or not."""
    weights = weights or {}
    hits = matches(ix, terms, mode)
    every = matches(ix, terms, "prefix" if mode == "prefix" else "any")
    df = every.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
    stats = ix.lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("avg"))  # one row
    x = hits.join(F.broadcast(df), "term").join(ix.lengths, "doc").join(F.broadcast(stats), F.lit(True))
    f = reduce(lambda a, b: a + b, (F.col(c) * F.lit(float(weights.get(c, 1.0))) for c in ix.fields))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.col("avg")))
    return x.groupBy("doc").agg(F.sum(part).alias("score"))


def snippet(text: Column, terms: list[str], size: int = 40, marks: tuple[str, str] = (">>>", "<<<")) -> Column:
    """`size` words around the first hit, hits marked, with dots where text is left out."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    hit = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "").isin(terms)
    first = F.greatest(F.lit(0), F.array_position(F.transform(w, hit), True) - 1 - size // 2).cast("int")
    part = F.transform(F.slice(w, first + 1, size), lambda x: F.when(hit(x), F.concat(F.lit(marks[0]), x, F.lit(marks[1]))).otherwise(x))
    return F.concat(F.when(first > 0, "...").otherwise(""), F.array_join(part, " "), F.when(F.size(w) > first + size, "...").otherwise(""))


# --- symbols


def symbol_index(nodes: DataFrame, stemmed: bool = True) -> Index:
    fields = {f: unicode_words(F.col(f)) for f in SYMBOL_WEIGHTS if f in nodes.columns}
    return index(nodes.select(F.col("id").alias("doc"), *fields), fields, stemmed)


def _holds(column: str, q: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(q)), F.lit(False))


def search_symbols(nodes: DataFrame, ix, query: str, limit: int = 40, compat: bool = False, grams=None) -> DataFrame:
    """(id, name, bonus, score): nodes that match all words of the query or hold it as a text, by bonus, score and name.

    The bonus is 0 for the name itself, 1 where the name holds the query, 2 for the qualified name, 3 for the signature
    or a match of words, 4 else. Where nothing is found, nodes that hold any word of the query, by the first such word.
    ix is an index of words, as it was made or in blocks. With stored trigrams of the nodes' texts only nodes that either
    of them names are looked at.
    """
    q = query.strip().lower()
    fields = [c for c in ("name", "qualifiedName", "signature", "docComment") if c in nodes.columns]
    text_hit = reduce(lambda a, b: a | b, (_holds(c, q) for c in fields))
    by_words = ix.scores(camel_words(query), SYMBOL_WEIGHTS_COMPAT if compat else SYMBOL_WEIGHTS).select(F.col("doc").alias("id"), "score")
    held = grams.candidates(q) if grams else None
    if held is None:
        both = nodes.join(by_words, "id", "left")
    else:
        named = held.select(F.col("doc").alias("id"), F.lit(None).cast("double").alias("score")).unionAll(by_words).groupBy("id").agg(F.max("score").alias("score"))
        both = nodes.join(named, "id")
    both = both.where(text_hit | F.col("score").isNotNull())
    bonus = F.when(F.col("name") == query.strip(), 0).when(_holds("name", q), 1).when(_holds("qualifiedName", q), 2).when(_holds("signature", q) | F.col("score").isNotNull(), 3).otherwise(4)
    found = cut(both.select("id", "name", bonus.alias("bonus"), F.coalesce("score", F.lit(0.0)).alias("score")).orderBy("bonus", F.desc("score"), "name", "id").limit(limit))
    if not found.isEmpty():
        return found
    some = [w for w in camel_words(query) if len(w) >= 2]
    if not some:
        return found
    each = [grams.candidates(w) for w in some] if grams else [None]
    if all(e is not None for e in each):
        nodes = nodes.join(reduce(DataFrame.unionAll, each).distinct().withColumnRenamed("doc", "id"), "id", "left_semi")
    at = reduce(lambda c, kv: c.when(_holds("name", kv[1]) | _holds("qualifiedName", kv[1]) | _holds("signature", kv[1]), kv[0]), enumerate(some), F.when(F.lit(False), 0))
    fuzzy = nodes.withColumn("_at", at).where("_at IS NOT NULL").orderBy("_at", "name", "id").limit(limit)
    return fuzzy.select("id", "name", F.lit(5).alias("bonus"), F.lit(0.0).alias("score"))


def node_text(n: DataFrame, body: Column | None = None) -> Column:
    """What semantic search reads of a node: name three times, qualified name twice, signature, comment, path words, and
    the first 500 characters of the body (a feature of that search)."""
    c = lambda x: F.coalesce(F.col(x), F.lit("")) if x in n.columns else F.lit("")
    parts = [c("name")] * 3 + [c("qualifiedName")] * 2 + [c("signature"), c("docComment"), F.regexp_replace(c("filePath"), r"[/\\]", " ")]
    return F.concat_ws(" ", *parts, *([F.substring(body, 1, 500)] if body is not None else []))


def tf_idf(ix: Index) -> DataFrame:
    """(doc, term, w) with vectors of length 1: term frequency in the document's tokens times ln(N / (1 + df)) + 1."""
    tf = reduce(lambda a, b: a + b, (F.col(f) for f in ix.fields))
    df = ix.postings.groupBy("term").agg(F.count("*").alias("df"))
    n = ix.lengths.where("n > 0").agg(F.count("*").alias("docs"))  # one row
    w = ix.postings.select("doc", "term", tf.alias("tf")).join(df, "term").join(ix.lengths, "doc").join(F.broadcast(n), F.lit(True))
    w = cut(w.select("doc", "term", (F.col("tf") / F.col("n") * (F.log(F.col("docs") / (1 + F.col("df"))) + 1)).alias("w")))
    size = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return w.join(size, "doc").where("size > 0").select("doc", "term", (F.col("w") / F.col("size")).alias("w"))


def most_similar(vectors: DataFrame, doc, k: int = 10) -> DataFrame:
    """(doc, score): the documents nearest to one of them by the cosine of their term vectors."""
    mine = vectors.where(F.col("doc") == doc).select("term", F.col("w").alias("_w"))
    rows = vectors.where(F.col("doc") != doc).join(mine, "term")
    return rows.groupBy("doc").agg(F.sum(F.col("w") * F.col("_w")).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


def relevance(n: DataFrame, query: str) -> Column:
    """Points of a node for a query: 100 for its name itself, 50 where the name holds it, 40 the qualified name, 20 more
    for the path, and for each of its words 10, 8 and 5."""
    q, terms = query.lower(), [t for t in dict.fromkeys(__import__("re").split(r"[\s,./\\-]+", query.lower())) if len(t) > 1]
    out = F.when(F.lower("name") == q, 100).when(_holds("name", q), 50).when(_holds("qualifiedName", q), 40).otherwise(0) + F.when(_holds("filePath", q), 20).otherwise(0)
    for t in terms:
        for column, points in (("name", 10), ("qualifiedName", 8), ("filePath", 5)):
            out = out + F.when(_holds(column, t), points).otherwise(0)
    return out


def merged(first: DataFrame, second: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, list, rank): rows (key, rank) of the first list, then those of the second that it lacks."""
    both = first.select(key, F.lit(0).alias("list"), "rank").unionAll(second.select(key, F.lit(1).alias("list"), "rank"))
    return both.groupBy(key).agg(F.min(F.struct("list", "rank")).alias("_at")).select(key, "_at.*").orderBy("list", "rank", key).limit(limit)


def with_rank(found: DataFrame, *order: Column) -> DataFrame:
    """A short, limited list with its place in the order, from 1."""
    from pyspark.sql import Window

    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of a limited list


def smart_search(nodes: DataFrame, edges: DataFrame, ix, query: str, semantic: DataFrame | None = None, mode: str = "hybrid", limit: int = 10, most: int = 8, grams=None) -> DataFrame:
    """(id, list, rank, name, type, filePath, startLine, signature, callers, n_callers, callees, n_callees): keyword hits,
    then semantic ones (doc, score) that are not among them; names of at most `most` callers and callees each."""
    parts = []
    if mode != "semantic":
        parts.append(with_rank(search_symbols(nodes, ix, query, limit, grams=grams), F.col("bonus"), F.desc("score"), F.col("name"), F.col("id")).select("id", "rank"))
    if mode != "keyword" and semantic is not None:
        parts.append(with_rank(semantic.orderBy(F.desc("score"), "doc").limit(limit), F.desc("score"), F.col("doc")).select(F.col("doc").alias("id"), "rank"))
    hits = merged(parts[0], parts[-1], "id", limit)  # a list is merged with itself where it is the only one
    hits = cut(hits.join(nodes.select("id", "name", "type", "filePath", "startLine", "signature"), "id"))
    calls = edges.where("type = 'calls'")
    for name, here, there in (("callers", "targetId", "sourceId"), ("callees", "sourceId", "targetId")):
        met = calls.join(F.broadcast(hits.select(F.col("id").alias(here))), here).join(nodes.select(F.col("id").alias(there), F.col("name").alias("_n")), there)  # at most `limit` rows
        names = F.array_join(F.slice(F.array_sort(F.collect_set("_n")), 1, most), ", ")
        hits = hits.join(met.groupBy(F.col(here).alias("id")).agg(names.alias(name), F.count("*").alias(f"n_{name}")), "id", "left").na.fill({name: "", f"n_{name}": 0})
    return hits


def with_aliases(found: DataFrame, rules: DataFrame, query: str, search, limit: int) -> DataFrame:
    """found (id, ..) and, where learned aliases (kind 'alias', term, target) of the query exist, what `search` finds for
    their targets, each id once, at most `limit`."""
    targets = [r.target for r in rules.where((F.col("kind") == "alias") & (F.lower("term") == query.lower())).select("target").distinct().orderBy("target").limit(20).collect()]
    lists = [found.select("id", F.lit(0).alias("list"))] + [search(t).select("id", F.lit(i + 1).alias("list")) for i, t in enumerate(targets)]
    every = reduce(DataFrame.unionAll, lists)
    return every.groupBy("id").agg(F.min("list").alias("list")).orderBy("list", "id").limit(limit)


def context_for(nodes: DataFrame, edges: DataFrame, lines: DataFrame, changes: DataFrame, ids: DataFrame, most_lines: int = 35, around: int = 3) -> dict[str, DataFrame]:
    """Sections on some symbols (id): their code with lines around it, callers and callees, types they are related to,
    and changes (file, ts, ..) of their files."""
    mine = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    at = mine.select("id", "filePath", F.greatest(F.lit(1), F.col("startLine") - around).alias("_a"), (F.least("endLine", F.col("startLine") + most_lines) + around).alias("_b"))
    code = lines.join(at, lines["doc"] == at["filePath"]).where("line_no BETWEEN _a AND _b").select("id", "line_no", "line")
    own, ends = mine.select(F.col("id").alias("own")), nodes.select("id", "name", "type")
    calls = edges.where("type = 'calls'").select("sourceId", "targetId")
    up = calls.join(own, calls["targetId"] == own["own"]).join(ends, F.col("sourceId") == F.col("id")).select("own", F.lit("caller").alias("role"), "id", "name")
    down = calls.join(own, calls["sourceId"] == own["own"]).join(ends, F.col("targetId") == F.col("id")).select("own", F.lit("callee").alias("role"), "id", "name")
    related = edges.where("type IN ('inherits', 'implements', 'uses')").select("sourceId", "targetId").join(own, F.col("sourceId") == F.col("own")).join(ends.where("type IN ('class', 'interface', 'type_alias', 'enum')"), F.col("targetId") == F.col("id"))
    files = mine.select(F.col("filePath").alias("file")).distinct()
    return {"symbols": mine, "code": code, "calls": up.unionAll(down), "related": related.select("own", "id", "name", "type"), "changes": changes.join(files, "file", "left_semi")}
