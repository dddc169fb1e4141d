"""Search structures that are written once and read by many queries: postings in blocks, and trigrams of texts.

Postings are blocks: a row holds what one word has in one shard of documents, as arrays, and beside it the least length
and the greatest count that any of them has. Shards are ranges of documents by length, so that blocks differ in what their
best document can score. Blocks lie in order of the word, so a query's filter on words leaves out the row groups of all
others, and its first look reads the bounds only, not the arrays. A search for the k best takes shards in descending order
of what their bounds allow, scores them exactly, and ends when the k-th best score so far is more than any shard left
could give.

Trigrams are lists of the documents of a batch that hold them, in order of the gram. A document that holds a text holds all
of its trigrams; those that hold its rarest ones are candidates, and are looked at. A regular expression goes by the literals that it requires.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import text
from tessera.operators.rules import required
from tessera.operators.search import Index, camel_words, index, snippet, stem
from tessera.operators.text import B, K1
from tessera.session import cut

#: Documents of one shard, about, and the shards that the first round of a search scores.
SHARD, FIRST = 4096, 4
#: Tokens of one shard, about, and places that documents are dealt to by length.
TOKENS, PLACES = 2_000_000, 200


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


# --- postings in blocks


@dataclass
class Blocks:
    """blocks (term, shard, n, n_min, docs, ns, <field>, <field>_max) and stats (docs, avg, filled, avg_filled): one row."""

    blocks: DataFrame
    stats: DataFrame
    fields: list[str]
    stemmed: bool = False

    def scores(self, terms: list[str], weights: dict[str, float] | None = None, mode: str = "all") -> DataFrame:
        return scored(self, terms, weights, mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str, stemmed: bool = False) -> Blocks:
        blocks = spark.read.parquet(f"{path}/blocks")
        fields = [c.removesuffix("_max") for c in blocks.columns if c.endswith("_max")]
        return cls(blocks, spark.read.parquet(f"{path}/stats"), fields, stemmed)


def _blocks_of_tokens(docs: pa.Array, ns: np.ndarray, tokens: list[pa.ListArray], shard: int, stemmed: bool) -> list[pa.Array]:
    """term, shard, n, n_min, each field's greatest count, docs, ns, each field's counts: what each word has in one shard."""
    m, k = len(docs), len(tokens)
    words = pa.concat_arrays([t.flatten() for t in tokens]).dictionary_encode()
    names, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
    if stemmed:
        names, codes_of = np.unique(np.array([stem(w) for w in names.to_pylist()], object).astype(str), return_inverse=True)
        names, codes = pa.array(names.tolist(), pa.string()), codes_of[codes]
    owner = np.concatenate([np.repeat(np.arange(m), t.value_lengths().fill_null(0).to_numpy()) for t in tokens])
    field = np.repeat(np.arange(k), [len(t.flatten()) for t in tokens])
    every = np.sort((codes * m + owner) * k + field)
    new = np.flatnonzero(np.diff(every, prepend=-1))
    held, times = every[new], np.diff(np.append(new, len(every)))
    pair = held // k
    first = np.diff(pair, prepend=-1) != 0
    place = np.cumsum(first) - 1
    counts = np.zeros((k, int(first.sum())), np.int64)
    counts[held % k, place] = times
    code, doc = pair[first] // m, pair[first] % m
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    ends = pa.array(np.append(starts, len(code)), pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(ends, x)
    return [
        names.take(pa.array(code[starts])), pa.array(np.full(len(starts), shard)), pa.array(np.diff(np.append(starts, len(code)))), pa.array(np.minimum.reduceat(ns[doc], starts)),
        *(pa.array(np.maximum.reduceat(c, starts)) for c in counts), listed(docs.take(pa.array(doc))), listed(pa.array(ns[doc])), *(listed(pa.array(c)) for c in counts),
    ]


def _in_blocks(size: int, stemmed: bool, names: list[str]):
    """Blocks of rows (doc, n, tokens of each field) in order of n: shards are runs of `size` rows, or fewer of long ones."""

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            ns, lo = batch.column(1).to_numpy().astype(np.int64), 0
            sums = np.cumsum(ns)
            while lo < len(ns):
                hi = min(lo + size, max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + TOKENS, "right"))))
                some = batch.slice(lo, hi - lo)
                if ns[lo:hi].any():
                    yield pa.RecordBatch.from_arrays(_blocks_of_tokens(some.column(0), ns[lo:hi], some.columns[2:], at, stemmed), names)
                lo, at = hi, at + 1

    return run


def save_blocks(ix: Index, path: str, shard: int = SHARD) -> None:
    """Writes an index in blocks. Texts are spread, as one row group may have all of them, and then dealt by length, as
    quantiles of it part them; what each word has in a shard is counted where the shard lies, so no token leaves its task."""
    docs = cut(ix.docs.repartition("doc"))
    n = _sum(F.size(F.coalesce(c, F.array().cast("array<string>"))) for c in ix.tokens.values()).cast("long")
    sized = docs.withColumn("_n", n)
    filled, n = F.col("_n") > 0, F.col("_n")
    quantiles = F.percentile_approx("_n", [i / PLACES for i in range(1, PLACES)], 10 * PLACES).alias("bounds")
    stats = cut(sized.agg(F.count("*").alias("docs"), F.avg(n).alias("avg"), F.count_if(filled).alias("filled"), F.avg(F.when(filled, n)).alias("avg_filled"), quantiles))
    stats.drop("bounds").coalesce(1).write.parquet(f"{path}/stats")
    found = stats.first()
    places = min(PLACES, max(ix.docs.sparkSession.sparkContext.defaultParallelism, found.docs // shard))
    bounds = F.array(*(F.lit(found.bounds[i * PLACES // places - 1]) for i in range(1, places) if found.bounds)).cast("array<long>")
    under, upto = F.size(F.filter(bounds, lambda b: b < n)), F.size(F.filter(bounds, lambda b: b <= n))  # those of one length are dealt to all places that it fills
    dealt = sized.where(filled).repartitionById(places, (under + F.pmod(F.xxhash64("doc"), upto - under + 1)).cast("int")).sortWithinPartitions("_n", "doc")
    fields, kind = list(ix.tokens), dict(ix.docs.dtypes)["doc"]
    kinds = [("term", "string"), ("shard", "long"), ("n", "long"), ("n_min", "long"), *((f"{f}_max", "long") for f in fields), ("docs", f"array<{kind}>"), ("ns", "array<long>"), *((f, "array<long>") for f in fields)]
    blocks = dealt.select("doc", "_n", *(c.alias(f) for f, c in ix.tokens.items())).mapInArrow(_in_blocks(shard, ix.stemmed, [x for x, _ in kinds]), ", ".join(f"{x} {t}" for x, t in kinds))
    blocks.sortWithinPartitions("term", "shard").write.parquet(f"{path}/blocks")


def _idf(kind: str, n: Column, df: Column) -> Column:
    if kind == "okapi":
        return F.log(n / (1 + df)) + 1
    return F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5)))


def _part(f: Column, n: Column, avg: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * n / avg))


@dataclass
class _Plan:
    """A query's blocks and what scores them: the words' idf, and the mean length."""

    blocks: DataFrame
    idf: dict[str, float]
    avg: float
    weights: dict[str, float]
    fields: list[str]
    least: int

    def value(self, suffix: str = "") -> Column:
        return _sum(F.col(f"{f}{suffix}") * F.lit(float(self.weights.get(f, 1.0))) for f in self.fields)

    def idf_of(self) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for kv in self.idf.items() for x in kv)), F.col("term"))

    def bounds(self) -> DataFrame:
        """(shard, bound) of shards that can hold an answer: no document of it scores more."""
        most = F.greatest(F.lit(0.0), self.idf_of()) * _part(self.value("_max"), F.col("n_min"), F.lit(self.avg))
        found = self.blocks.groupBy("shard").agg(F.sum(most).alias("bound"), F.count("*").alias("terms"))
        return found.where(F.col("terms") >= self.least).select("shard", (F.col("bound") * (1 + 1e-9)).alias("bound"))

    def of(self, shards: list[int] | None = None) -> DataFrame:
        """(doc, score) of all documents of some shards, or of all."""
        rows = self.blocks if shards is None else self.blocks.where(F.col("shard").isin(shards))
        x = rows.select("term", F.explode(F.arrays_zip("docs", "ns", *self.fields)).alias("x")).select("term", "x.*")
        part = self.idf_of() * _part(self.value(), F.col("ns"), F.lit(self.avg))
        out = x.groupBy(F.col("docs").alias("doc")).agg(F.sum(part).alias("score"), F.count("*").alias("terms"))
        return out.where(F.col("terms") >= self.least).select("doc", "score")


def _plan(ix: Blocks, terms: list[str], weights: dict[str, float] | None, mode: str, idf: str) -> _Plan | None:
    terms = list(dict.fromkeys(stem(t) for t in terms) if ix.stemmed else dict.fromkeys(terms))
    stats = ix.stats.first()
    n, avg = (stats.filled, stats.avg_filled) if idf == "okapi" else (stats.docs, stats.avg)
    blocks = ix.blocks.where(F.col("term").isin(terms)) if terms else None
    if blocks is None or not n or not avg:
        return None
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    known = {r.term: r.idf for r in df.select("term", _idf(idf, F.lit(n), F.col("df")).alias("idf")).collect()}  # a row for each word of the query
    if not known or (mode == "all" and len(known) < len(terms)):
        return None
    return _Plan(blocks, known, avg, weights or {}, ix.fields, len(terms) if mode == "all" else 1)


def scored(ix: Blocks, terms: list[str], weights: dict[str, float] | None = None, mode: str = "all", idf: str = "fts") -> DataFrame:
    """(doc, score) of every match; modes are all and any. idf: fts, or okapi (which counts documents with words only)."""
    plan = _plan(ix, terms, weights, mode, idf)
    if plan is None:
        return ix.blocks.select(F.explode("docs").alias("doc"), F.lit(0.0).alias("score")).limit(0)
    return plan.of()


def top_k(ix: Blocks, terms: list[str], k: int, weights: dict[str, float] | None = None, mode: str = "all", idf: str = "fts", seen: list[int] | None = None) -> DataFrame:
    """(doc, score): the k best matches, ties to the smaller doc. Shards are scored in rounds of double size, in
    descending order of their bounds, until none that is left can reach the k-th best score. seen: gets the number of shards of each round."""
    plan = _plan(ix, terms, weights, mode, idf)
    best = ix.blocks.select(F.explode("docs").alias("doc"), F.lit(0.0).alias("score")).limit(0)
    if plan is None:
        return best
    bounds = cut(plan.bounds().withColumn("place", F.row_number().over(Window.orderBy(F.desc("bound"), "shard"))))  # one row a shard of the matches
    total, at, size, reached = bounds.count(), 0, FIRST, None
    while at < total:
        due = bounds.where((F.col("place") > at) & (F.col("place") <= at + size))
        shards = [r.shard for r in (due if reached is None else due.where(F.col("bound") >= reached)).collect()]
        if not shards:
            break
        if seen is not None:
            seen.append(len(shards))
        best = cut(best.unionAll(plan.of(shards)).orderBy(F.desc("score"), "doc").limit(k))
        last = best.orderBy("score", F.desc("doc")).limit(1).collect()
        reached = last[0].score if last and best.count() >= k else None
        at, size = at + size, min(size * 2, 4096)
    return best


def blocks_of(spark: SparkSession, docs: DataFrame, fields: dict[str, Column], path: str, stemmed: bool = False, shard: int = SHARD) -> Blocks:
    """Indexes docs (doc, ..), writes the blocks to path and reads them from there."""
    save_blocks(index(docs, fields, stemmed), path, shard)
    return Blocks.load(spark, path, stemmed)


def search_content(files: DataFrame, ix: Blocks, query: str, limit: int = 200) -> DataFrame:
    """(doc, score, snippet) of files (doc, text) that hold all words of a query, the `limit` best first; other texts aren't read."""
    terms = camel_words(query)
    best = top_k(ix, terms, limit)
    texts = narrowed(files, best.select("doc")).select("doc", snippet(F.col("text"), terms).alias("snippet"))
    return best.join(texts, "doc").orderBy(F.desc("score"), "doc")


# --- trigrams

GRAM, RAREST = 3, 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def fold(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def grams_of(literal: str) -> list[str]:
    """Trigrams of a literal in lower case; none with a sigma, whose small form depends on what follows."""
    x = literal.lower()
    return [g for g in dict.fromkeys(x[i : i + GRAM] for i in range(len(x) - GRAM + 1)) if not set(g) & set("σς")]


#: Characters of texts whose trigrams are listed together, and parts that a frequent trigram's lists are dealt to.
TOGETHER, PARTS = 2_000_000, 16


def _grams_of_texts(texts: list[str], owner: np.ndarray, docs: pa.Array) -> pa.RecordBatch:
    """The distinct trigrams of some texts, each with the docs (`owner` of each text) that hold it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[codes] = True
    letters = np.flatnonzero(used)
    rank = np.zeros(0x110000, np.int64)
    rank[letters] = np.arange(len(letters))
    x, n, row = rank[codes], len(letters), np.repeat(np.arange(len(texts)), sizes)
    whole = row[: -GRAM + 1] == row[GRAM - 1 :]  # within one text
    grams = ((x[:-2] * n + x[1:-1]) * n + x[2:])[whole]
    held = np.sort(grams * len(docs) + owner[row[: -GRAM + 1][whole]])
    held = held[np.diff(held, prepend=-1) != 0]
    gram, doc = held // len(docs), held % len(docs)
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    first = gram[starts]
    names = [chr(a) + chr(b) + chr(c) for a, b, c in zip(letters[first // (n * n)].tolist(), letters[first // n % n].tolist(), letters[first % n].tolist(), strict=True)]
    ends = np.append(starts, len(gram))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), docs.take(pa.array(doc)))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.diff(ends)), lists], ["gram", "n", "docs"])


def _listed(batches):
    for batch in batches:
        docs, columns = batch.column(0), [c.to_pylist() for c in batch.columns[1:]]
        size, at = np.cumsum([sum(len(x) for x in row if x) for row in zip(*columns, strict=True)]), 0
        while at < len(docs):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right")))
            some = [(x, k - at) for c in columns for k, x in enumerate(c[at:end], at) if x and len(x) >= GRAM]
            if some:
                yield _grams_of_texts([x for x, _ in some], np.array([k for _, k in some]), docs.slice(at, end - at))
            at = end


def save_trigrams(docs: DataFrame, columns: list[str], path: str) -> None:
    """Writes the distinct trigrams of docs (doc, columns), over all columns together: rows (gram, n, docs), each with the
    docs of one batch that hold the gram. Only these lists are shuffled, once, and lie in order of the gram in each file."""
    texts = docs.select("doc", *(F.make_valid_utf8(F.lower(F.col(c).cast("string"))) for c in columns))
    found = texts.mapInArrow(_listed, f"gram string, n long, docs array<{dict(docs.dtypes)['doc']}>").withColumn("part", F.spark_partition_id() % PARTS)
    found.repartition("gram", "part").drop("part").sortWithinPartitions("gram").write.parquet(path)


@dataclass
class Trigrams:
    """rows (gram, n, docs), read from where they were written."""

    rows: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trigrams:
        return cls(spark.read.parquet(path))

    def candidates(self, literal: str) -> DataFrame | None:
        """(doc) of documents that hold the rarest trigrams of a literal; None if it is too short to say."""
        grams = grams_of(literal)
        if not grams:
            return None
        some = self.rows.where(F.col("gram").isin(grams))
        counts = {r.gram: r.n for r in some.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a trigram of the literal
        if len(counts) < len(grams):
            return self.rows.select(F.explode("docs").alias("doc")).limit(0)
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        mark = F.element_at(F.create_map(*(F.lit(x) for i, g in enumerate(rarest) for x in (g, 1 << i))), F.col("gram"))
        held = self.rows.where(F.col("gram").isin(rarest)).select(F.explode("docs").alias("doc"), mark.alias("mark"))
        return held.groupBy("doc").agg(F.bit_or("mark").alias("marks")).where(F.col("marks") == (1 << len(rarest)) - 1).select("doc")

    def candidates_of(self, pattern: str) -> DataFrame | None:
        """(doc) of documents that may match a regular expression; None if it requires no literal that is long enough."""
        literals = required(pattern)
        if not literals:
            return None
        each = [self.candidates(x) for x in sorted(literals)]
        return reduce(DataFrame.unionAll, each).distinct() if all(e is not None for e in each) else None


def narrowed(docs: DataFrame, found: DataFrame | None, most: int = 1000) -> DataFrame:
    """docs that are candidates. A few of them are named in a filter on doc, which leaves out the row groups of others;
    more are joined."""
    if found is None:
        return docs
    few = found.limit(most + 1).collect()
    if len(few) <= most:
        return docs.where(F.col("doc").isin([r.doc for r in few]))
    return docs.join(found, "doc", "left_semi")


def containing(ix: Trigrams, docs: DataFrame, columns: list[str], literal: str) -> DataFrame:
    """docs that hold a literal in one of some columns, whatever the case of A-Z."""
    held = reduce(lambda a, b: a | b, (F.coalesce(F.contains(folded(F.col(c)), F.lit(fold(literal))), F.lit(False)) for c in columns))
    return narrowed(docs, ix.candidates(literal)).where(held)


def grep(ix: Trigrams, docs: DataFrame, pattern: str, **options) -> DataFrame:
    """`text.grep` over the documents that the trigrams leave; all of them are read if the pattern requires nothing, or if
    lines without a match are asked for."""
    if options.get("invert"):
        return text.grep(docs, pattern, **options)
    return text.grep(narrowed(docs, ix.candidates_of(pattern)), pattern, **options)
