"""Text operators: tokenising, postings, ranking, line search."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

K1, B = 1.2, 0.75

#: Groups of words that a search may take for each other. A small choice of our own; callers pass their own groups, of
#: any number, to `expand`.
SYNONYMS = (
    ("begin", "start", "launch"), ("finish", "end", "stop", "halt"), ("big", "large", "huge"), ("small", "little", "tiny"), ("fast", "quick", "rapid"),
    ("count", "number", "total"), ("folder", "directory"), ("picture", "image", "photo"), ("user", "person", "customer"), ("token", "secret", "password"),
    ("list", "sequence", "series"), ("wrong", "broken", "invalid"), ("shop", "store", "market"), ("price", "cost", "amount"),
)


def code_tokens(text: Column) -> Column:
    """Words of code: camel case and digits split off, symbols as spaces, lower case, two characters at least."""
    x = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    x = F.regexp_replace(x, "([0-9]+)", " $1 ")
    x = F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))
    return F.filter(F.split(x, " "), lambda w: F.length(w) >= 2)


#: A word border in ASCII. What \b takes for part of a word differs between Java's versions, and from other engines.
BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def plain_borders(pattern: str) -> str:
    """A pattern with the word borders in ASCII."""
    return re.sub(r"\\(.)", lambda m: BORDER if m[1] == "b" else m[0], pattern)


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """(doc, term, tf, dl) of docs (doc, ...) by an array of tokens."""
    rows = docs.select("doc", F.size(tokens).alias("dl"), F.explode(tokens).alias("term"))
    return rows.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """(n, avgdl): documents that have a token, and their mean length."""
    return docs.select(F.size(tokens).alias("dl")).where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def expand(terms: list[str], groups=SYNONYMS) -> list[str]:
    """Terms, then their synonyms, in order, each once."""
    out = list(dict.fromkeys(terms))
    for t in list(out):
        for g in groups:
            if t in g:
                out += [w for w in g if w not in out]
    return out


def _equals(term: str):
    return lambda x: x == term


def term_counts(docs: DataFrame, tokens: Column, terms: list[str]) -> DataFrame:
    """(doc, dl, tf) of each of docs: its number of tokens, and how often each of the terms is among them. Each text is
    split once, and no token leaves its row."""
    rows = docs.select("doc", tokens.alias("_w"))
    counts = F.array(*(F.size(F.filter("_w", _equals(t))) for t in terms))
    return cut(rows.select("doc", F.coalesce(F.size("_w"), F.lit(0)).alias("dl"), counts.alias("tf")))


def okapi(docs: DataFrame, tokens: Column, terms: list[str], threshold: float = 0.01) -> DataFrame:
    """(doc, score): Okapi BM25 over the distinct terms, idf = ln(N / (1 + df)) + 1."""
    terms = list(dict.fromkeys(terms))
    rows = term_counts(docs, tokens, terms)
    df = F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))))
    stats = rows.where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), df.alias("df"))  # one row
    hits = rows.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats), F.lit(True))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.zip_with("tf", "df", lambda tf, d: (F.log(F.col("n") / (1 + d)) + 1) * tf * (K1 + 1) / (tf + norm))
    return hits.select("doc", F.aggregate(part, F.lit(0.0), lambda s, x: s + x).alias("score")).where(F.col("score") >= threshold)


def field_bm25(docs: DataFrame, fields: dict[str, float], terms: list[str]) -> DataFrame:
    """(doc, score) over weighted fields of docs (doc, fields): each field is ranked on its own, then summed by weight."""
    total = None
    for name, weight in fields.items():
        one = okapi(docs, words(F.col(name)), terms, threshold=float("-inf")).select("doc", (F.col("score") * weight).alias("score"))
        total = one if total is None else total.unionAll(one)
    return total.groupBy("doc").agg(F.sum("score").alias("score"))


def find_file(files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(filePath, score): 100 for the base name itself, 80 for its start, 60 where the path holds the query."""
    q, base = query.lower(), F.lower(F.element_at(F.split("filePath", "/"), -1))
    score = F.when(base == q, 100).when(F.startswith(base, F.lit(q)), 80).when(F.contains(F.lower("filePath"), F.lit(q)), 60)
    return files.select("filePath").distinct().withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "filePath").limit(limit)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** any, * within a segment, ? one character."""
    out, i = "^", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2 + (glob[i + 2 : i + 3] == "/")
            continue
        c = glob[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else ("\\" + c if c in ".+()[]{}^$|\\" else c)
        i += 1
    return out + "$"


def lines(docs: DataFrame) -> DataFrame:
    """(doc, line_no, line), numbered from 1."""
    return docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def grep(docs: DataFrame, pattern: str, context: int = 0, invert: bool = False, whole_word: bool = False, ignore_case: bool = False) -> DataFrame:
    """(doc, line_no, line, n_matches[, before, after]) of matching lines; context lines come joined by newlines. Only the
    places of matching lines leave a document's array, each with its own slice of it."""
    p = ("(?i)" if ignore_case else "") + (f"{BORDER}(?:{pattern}){BORDER}" if whole_word else pattern)
    wanted = (lambda line: ~line.rlike(p)) if invert else (lambda line: line.rlike(p))
    if not context:
        rows = lines(docs).where(wanted(F.col("line")))
        return rows.withColumn("n_matches", F.regexp_count("line", F.lit(p)))
    line = lambda i: F.get(F.col("_all"), i)
    joined = lambda first, n: F.array_join(F.slice("_all", first, n), "\n")

    def hit(i):
        first = F.greatest(F.lit(1), i + 1 - context)
        return F.struct((i + 1).alias("line_no"), line(i).alias("line"), joined(first, i + 1 - first).alias("before"), joined(i + 2, F.lit(context)).alias("after"))

    places = F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda i: wanted(line(i)))
    rows = docs.where("text IS NOT NULL").select("doc", F.split("text", "\n", -1).alias("_all")).select("doc", F.explode(F.transform(places, hit)).alias("_x"))
    return rows.select("doc", "_x.line_no", "_x.line", F.regexp_count("_x.line", F.lit(p)).alias("n_matches"), "_x.before", "_x.after")


def cosine_top_k(vectors: DataFrame, query_id: int, k: int = 10) -> DataFrame:
    """(id, score): the vectors (id, v) nearest to one of them by cosine."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = vectors.where(F.col("id") == query_id).select(F.col("v").alias("_q")).limit(1)
    rows = vectors.where(F.col("id") != query_id).join(F.broadcast(q), F.lit(True))  # one row
    score = dot(F.col("v"), F.col("_q")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("_q"), F.col("_q"))))
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays as sets."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


#: Words of the parity signature of a set (64 bits each), and sets of a block.
LANES, BLOCK = 4, 256


def _signature(w: Column, lane: int) -> Column:
    """64 bits, each the parity of how many of a set's hashes are dealt to it: two sets differ in as many members at least as bits."""
    mine = F.filter(w, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(LANES - 1)) == lane)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of distinct sets (doc, w), a < b, by a prefix filter: similar sets share one of their rarest tokens.

    The prefix of a set of n words in a global order holds n - ceil(threshold n) + 1 of them; pairs without a common
    prefix word cannot reach the threshold, so the join is exact. A pair stays where it meets only if the words from there
    on can be enough, as they are at the first word that a similar pair shares, and if few bits of the signatures differ.
    Words go by 64 bits of hash. Sets travel once for each block of others that they may be similar to, not for each pair.
    """
    named = cut(sets.select("doc", F.array_sort(F.array_distinct(F.transform("w", lambda x: F.xxhash64(x)))).alias("w")).where(F.size("w") > 0))
    rare = named.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    shared = named.select("doc", F.explode("w").alias("t")).join(rare, "t")
    ranked = shared.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))  # a set's words at most
    signed = named.select("doc", F.size("w").alias("n"), *(_signature(F.col("w"), i).alias(f"s{i}") for i in range(LANES)))
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1 - (F.col("n") - F.size("o"))  # words of one set come before all others
    prefix = ranked.join(signed, "doc").select("doc", "n", *(f"s{i}" for i in range(LANES)), (F.col("n") - F.size("o")).alias("lone"), F.posexplode(F.transform(F.slice("o", 1, F.greatest(F.lit(0), first).cast("int")), lambda x: x["t"])).alias("at", "t"))
    prefix = cut(prefix.select("doc", "t", "n", (F.col("n") - F.col("lone") - F.col("at")).alias("left"), *(f"s{i}" for i in range(LANES))))
    a, b = (prefix.select("t", F.col("doc").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "left", *(f"s{i}" for i in range(LANES))))) for x in "ab")
    length_ok = (F.col("na") >= F.lit(threshold) * F.col("nb")) & (F.col("nb") >= F.lit(threshold) * F.col("na"))
    need = F.lit(threshold) / (1 + F.lit(threshold)) * (F.col("na") + F.col("nb")) - 1e-6
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(LANES)))
    can = length_ok & (F.least("lefta", "leftb") >= need) & (F.col("na") + F.col("nb") - differ >= 2 * need)
    return _confirmed(cut(a.join(b, "t").where((F.col("a") < F.col("b")) & can).select("a", "b").distinct()), named, threshold)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of sets (doc, w: hashes in order) that reach the threshold. Sets of one least
    neighbour lie in one block, or in several if they are many; a task has the pairs of two blocks, and their sets once."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = cut(both.groupBy("id").agg(F.least("id", F.min("other")).alias("label")))
    few = max(1, near.count() // BLOCK)
    size = near.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    own = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("label"), F.lit(few))).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("parts"))))
    block = cut(near.join(size, "label").select("id", own.alias("block")))
    of = lambda x: block.select(F.col("id").alias(x), F.col("block").alias(f"_{x}"))
    met = cut(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j")))
    at = [F.col("i").alias("k"), F.col("j").alias("l")]
    held = met.select(*at, F.col("a").alias("doc")).unionAll(met.select(*at, F.col("b").alias("doc"))).distinct().join(sets, "doc")
    kind = dict(pairs.dtypes)["a"]

    def confirm(some: pa.Table, held: pa.Table) -> pa.Table:
        ids, w = held.column("doc").to_pylist(), held.column("w").combine_chunks()
        sizes = w.value_lengths().to_numpy()
        place = np.unique(w.flatten().to_numpy(), return_inverse=True)[1]
        member = np.split(place, np.cumsum(sizes)[:-1])
        index = {d: n for n, d in enumerate(ids)}
        seen, out, last = np.zeros(len(place) + 1, bool), [], None
        rows = sorted((index[a], index[b]) for a, b in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True))
        for a, b in rows:
            if a != last:
                if last is not None:
                    seen[member[last]] = False
                seen[member[a]] = True
                last = a
            n = int(np.count_nonzero(seen[member[b]]))
            out.append((ids[a], ids[b], n / (int(sizes[a]) + int(sizes[b]) - n)))
        good = [x for x in out if x[2] >= threshold]
        return pa.table([pa.array([x[k] for x in good], t) for k, t in ((0, held.column("doc").type), (1, held.column("doc").type), (2, pa.float64()))], ["a", "b", "similarity"])

    return met.groupBy("i", "j").cogroup(held.groupBy("k", "l")).applyInArrow(confirm, f"a {kind}, b {kind}, similarity double")


def token_sets(docs: DataFrame, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(doc, h) of docs with tokens, h naming their set, and (h, doc, w, copies) of the distinct sets, by their least doc; w
    are 64 bits of hash for each token, as the tokens themselves would take several times the room on disk."""
    sets = docs.select("doc", F.array_sort(F.array_distinct(tokens)).alias("w")).where(F.size("w") > 0)
    sets = cut(sets.select("doc", F.sha2(F.array_join("w", " "), 256).alias("h"), F.transform("w", lambda x: F.xxhash64(x)).alias("w")))
    return sets.select("doc", "h"), cut(sets.groupBy("h").agg(F.min("doc").alias("doc"), F.first("w").alias("w"), F.count("*").alias("copies")))
