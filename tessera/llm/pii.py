r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers, and give their places. These are the seeds.
Every other word that holds a digit or an @ is a candidate, and so is every run of digit groups. Lexical patterns are
induced from contexts: the word to the left, or to the right, with the shape in the slot (digits as 9, letters as a or
A; for all words with an @ the same), and once more with a wider slot, in which runs of digits of any length are alike.
Patterns and instances (the distinct strings) form a graph. In each round a pattern that holds enough known instances of
a kind is trusted by their share among all its instances; a candidate's score joins its best pattern of either side by a
noisy or. Candidates of a high score become known, so that in the next round their other contexts induce new patterns,
until a round finds nothing new. Known instances that are no seeds become new spans wherever a trusted pattern has them.

The places of a kind's matches come from the lengths of the matches and of the texts between them. The Java patterns
are the contract's, written so that no input makes them backtrack: runs are possessive, and a match can only start at
a run's start or where the last match ended.

Edge cases: null texts are empty and have no spans. Rows are told apart by a number of their own, so null and repeated
doc_ids are fine, each row is returned. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_GROUP = r"[+(]*+[0-9][0-9().-]*+"
#: Digit groups parted by single spaces, two at least.
RUN = rf"(?<![^{SPACE}])(?:{_GROUP}\x20(?={_GROUP}[,;:!?]*+(?![^{SPACE}])))++{_GROUP}"
WORD = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"

#: Known instances that a pattern needs, what is added to its instances' number, and the score that makes a candidate known.
MIN_KNOWN, SMOOTH, ACCEPT = 5, 1.0, 0.9
#: Matches whose ends are summed up at a time, and the longest shape that is kept as it is (others by their digest).
BLOCK, LONG_SHAPE = 256, 60
#: Shortest candidate, in letters and digits, and the digits it must have if it has no @.
MIN_CORE, MIN_DIGITS = 7, 5


def _luhn(digits: str) -> str:
    d = f"int(substr(reverse({digits}), i + 1, 1))"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + IF(i % 2 = 0, {d}, IF(2 * {d} > 9, 2 * {d} - 9, 2 * {d}))) % 10 = 0"


def _passes(kind: str) -> str:
    """A condition on the match m."""
    if kind == "ip":
        return "forall(split(m, '[.]'), x -> length(ltrim('0', x)) <= 3 AND coalesce(int(nullif(ltrim('0', x), '')), 0) <= 255)"
    if kind == "card":
        digits = "regexp_replace(m, '[^0-9]', '')"
        return f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {_luhn(digits)} ELSE false END"
    if kind == "phone":
        return "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 10 AND 15"
    return "true"


def _found(text: Column, kind: str) -> tuple[Column, Column]:
    """All matches, and the texts between them."""
    pattern = (PATTERNS | {"word": WORD, "run": RUN})[kind]
    some = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9@]" if kind == "word" else "[0-9]")
    matches = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(some, F.split(text, pattern, -1)).otherwise(F.array(text))
    return matches, gaps


def _placed(matches: str, gaps: str) -> str:
    """array<struct<m, start, end>> of matches, in code points. Ends are summed up in blocks of matches, then over blocks, and
    the blocks put together once."""
    lengths = f"zip_with(transform(slice({gaps}, 1, size({matches})), g -> length(g)), transform({matches}, m -> length(m)), (g, n) -> g + n)"
    blocks = f"transform(array({lengths}), l -> transform(sequence(0, (size(l) - 1) div {BLOCK}), b -> slice(l, b * {BLOCK} + 1, {BLOCK})))[0]"
    sums = "struct(0 AS at, array() :: array<int> AS ends)"
    inner = f"transform({blocks}, x -> aggregate(x, {sums}, (s, n) -> struct(s.at + n AS at, array_append(s.ends, s.at + n) AS ends)))"
    starts = f"aggregate(inner, {sums}, (s, i) -> struct(s.at + i.at AS at, array_append(s.ends, s.at) AS ends), s -> s.ends)"
    outer = f"transform(array({inner}), inner -> flatten(zip_with(inner, {starts}, (i, at) -> transform(i.ends, e -> e + at))))[0]"
    return f"CASE WHEN size({matches}) = 0 THEN array() ELSE zip_with({matches}, {outer}, (m, e) -> struct(m, e - length(m) AS start, e AS end)) END"


def _first_after(spans: str, place: str) -> str:
    """Number of the first of a kind's spans (in order, apart from each other) that ends after a place, by halving."""
    middle = "int((s.lo + s.hi) div 2)"
    step = f"CASE WHEN s.lo >= s.hi THEN s WHEN get({spans}, {middle}).end > {place} THEN struct(s.lo AS lo, {middle} AS hi) ELSE struct({middle} + 1 AS lo, s.hi AS hi) END"
    return f"aggregate(sequence(1, length(bin(size({spans})))), struct(0 AS lo, size({spans}) AS hi), (s, n) -> {step}, s -> s.lo)"


def _kind_of(start: str, end: str) -> str:
    """The kind of the first base span that a word overlaps, or -1; x holds each kind's spans."""
    each = (f"transform(array(get(x.{k}_b, {_first_after(f'x.{k}_b', start)})), b -> CASE WHEN b.start < {end} THEN struct(b.start AS at, {i} AS kind) END)[0]" for i, k in enumerate(KINDS))
    return f"coalesce(array_min(array({', '.join(each)})).kind, -1)"


def _last_word(gap: str) -> str:
    blanks = r"\t\n\u000b\f\r"
    return f"substring_index(rtrim(translate({gap}, '{blanks}', '     ')), ' ', -1)"


def annotated(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, words): base spans (start, kind, end, m) by start, and words with a digit or @ (start, end, m, left, right, kind)."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = (*KINDS, "word", "run")
    for k in kinds:
        matches, gaps = _found(F.col("text"), k)
        d = d.withColumns({f"{k}_m": matches, f"{k}_g": gaps})
    right = {"word": f"^[{SPACE}]*+([^{SPACE}]++)", "run": f"^[^{SPACE}]*+[{SPACE}]++([^{SPACE}]++)"}  # a run may end within a word
    around = [F.expr(f"transform({k}_g, g -> {_last_word('g')})").alias(f"{k}_left") for k in right]
    around += [F.expr(f"transform({k}_g, g -> regexp_extract(g, r'{p}', 1))").alias(f"{k}_right") for k, p in right.items()]
    d = d.select("row", "doc_id", *(F.col(f"{k}_m") for k in kinds), *around, *(F.expr(_placed(f"{k}_m", f"{k}_g")).alias(f"{k}_p") for k in kinds))
    own = {f"{k}_b": F.expr(f"filter({k}_p, p -> {_passes(k).replace('m,', 'p.m,').replace('(m', '(p.m')})") for k in KINDS}
    d = d.withColumns(own)
    base = [F.expr(f"transform({k}_b, p -> struct(p.start AS start, {i} AS kind, p.end AS end, p.m AS m))") for i, k in enumerate(KINDS)]
    d = d.withColumn("base", F.array_sort(F.concat(*base)))
    kind, bound = _kind_of("w.start", "w.end"), ", ".join(f"{k}_b AS {k}_b" for k in KINDS)
    # what each word looks up is bound once: an array named within the lambda could be made anew for every word
    words = [
        f"transform(array(struct({k}_p AS p, {k}_left AS l, {k}_right AS r, {bound})), x -> transform(x.p, (w, i) -> struct(w.start AS start, w.end AS end, w.m AS m, lower(get(x.l, i)) AS left, lower(get(x.r, i + 1)) AS right, {kind} AS kind)))[0]"
        for k in ("word", "run")
    ]
    return d.select("row", "doc_id", "base", F.concat(*map(F.expr, words)).alias("words"))


def candidates(rows: DataFrame) -> DataFrame:
    """(row, start, end, instance, kind, side, pattern): each candidate and seed word's patterns; kind -1 for candidates."""
    w = rows.select("row", F.explode("words").alias("w")).select("row", "w.*")
    core = F.regexp_extract("m", "^[^A-Za-z0-9+(]*+(.*[A-Za-z0-9])", 1)
    w = w.withColumn("instance", core).withColumn("lead", F.instr(F.col("m"), F.col("instance")) - 1)
    w = w.where((F.length("instance") >= MIN_CORE) & (F.contains("instance", F.lit("@")) | (F.regexp_count("instance", F.lit("[0-9]")) >= MIN_DIGITS)))
    w = w.withColumn("start", (F.col("start") + F.col("lead")).cast("int")).withColumn("end", (F.col("start") + F.length("instance")).cast("int"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("instance", "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]", "9")
    kept = lambda c: F.when(F.length(c) > LONG_SHAPE, F.md5(c.cast("binary"))).otherwise(c)
    is_address = F.contains("instance", F.lit("@"))
    w = w.withColumn("slot", F.when(is_address, "@").otherwise(kept(shape))).withColumn("wide", F.when(is_address, "@").otherwise(kept(F.concat(F.lit("~"), F.regexp_replace(shape, "9+", "9")))))
    sides = [F.when(F.col(c).rlike("[a-z]"), F.struct(F.lit(c).alias("side"), F.concat(F.lit(mark), F.col(c), F.lit(" "), F.col(slot)).alias("pattern"))) for c, mark in (("left", "<"), ("right", ">")) for slot in ("slot", "wide")]
    x = F.explode(F.array_distinct(F.filter(F.array(*sides), lambda x: x.isNotNull())))
    return w.select("row", "start", "end", "instance", "kind", x.alias("x")).select("row", "start", "end", "instance", "kind", "x.side", "x.pattern")


def discover(found: DataFrame, min_known: int = MIN_KNOWN, smooth: float = SMOOTH, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind, pattern): unseen instances that became known, with the trusted patterns that hold them."""
    edges = cut(found.groupBy("side", "pattern", "instance").agg(F.max("kind").alias("seed")))
    known, seeds = None, edges.select("instance", "seed").where("seed >= 0").groupBy("instance").agg(F.max("seed").alias("label"))
    labelled = cut(edges.join(seeds, "instance", "left").select("side", "pattern", "instance", F.coalesce("label", F.lit(-1)).alias("label")))
    while True:
        n = labelled.groupBy("side", "pattern").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == i).alias(f"k{i}") for i in range(len(KINDS))))
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"k{i}").alias("known")) for i in range(len(KINDS)))))
        trust = n.select("side", "pattern", "n", each.alias("x")).where(F.col("x.known") >= min_known)
        trust = cut(trust.select("side", "pattern", "x.kind", (F.col("x.known") / (F.col("n") + smooth)).alias("trust")))
        links = labelled.where("label < 0").join(trust, ["side", "pattern"])
        best = links.groupBy("instance", "kind", "side").agg(F.max("trust").alias("t"))
        scores = best.groupBy("instance", "kind").agg((1 - F.product(1 - F.col("t"))).alias("score")).where(F.col("score") >= accept)
        new = cut(scores.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("label")))
        if new.isEmpty():
            break
        known = new if known is None else known.unionAll(new)
        labelled = cut(labelled.join(new.withColumnRenamed("label", "_new"), "instance", "left").select("side", "pattern", "instance", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.coalesce("_new", F.lit(-1))).alias("label")))
    if known is None:
        return edges.select("instance", F.lit(0).alias("kind"), "pattern").limit(0)
    held = edges.select("instance", "pattern").join(known, "instance").join(trust.select("pattern", "kind"), "pattern")
    return held.where("label = kind").select("instance", "kind", "pattern").distinct()


def spans(docs: DataFrame, **options) -> DataFrame:
    """(row, doc_id, base, more): base spans and discovered ones, arrays of (start, kind, end)."""
    rows = cut(annotated(docs))
    found = candidates(rows)
    new = cut(discover(found, **options))
    at = found.where("kind < 0").drop("kind", "side").join(new, ["instance", "pattern"]).groupBy("row", "start", "end").agg(F.collect_set("kind").alias("kinds"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    whole = at.withColumn("upto", F.max("end").over(before)).where("upto IS NULL OR upto < end")  # not a run's last group
    hits = whole.select("row", "start", F.explode("kinds").alias("kind"), "end").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))
    slim = rows.select("row", "doc_id", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))).alias("base"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return slim.join(hits, "row", "left").withColumn("more", F.coalesce("more", none))


def written(spans_: Column) -> Column:
    """kind:start:end of spans, comma-joined by start and then kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans_), one), ",")


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered) of each row; counts are of base spans."""
    s = spans(docs, **options)
    counts = [F.expr(f"size(filter(base, b -> b.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return s.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_discovered"))
