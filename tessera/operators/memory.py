"""Notes that fade, decisions and their conflicts, two-sided sync. Times are given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import CATEGORY_IMPORTANCE
from tessera.operators.alike import similar_classes
from tessera.operators.store import upsert
from tessera.operators.text import words

RATE, BOOST, RECENCY_DAYS, WEIGHTS = 0.95, 0.1, 30.0, (0.5, 0.3, 0.2)


def default_importance(category: Column) -> Column:
    out = F.lit(0.5)
    for name, value in CATEGORY_IMPORTANCE.items():
        out = F.when(category == name, value).otherwise(out)
    return out


def days_between(now: Column, then: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000.0)


def decayed(importance: Column, days: Column, rate: float = RATE) -> Column:
    """importance * rate^days; changes of at most a thousandth, and within a hundredth of a day, are left out."""
    new = importance * F.pow(F.lit(rate), days)
    return F.when((days < 0.01) | (importance - new <= 0.001), importance).otherwise(new)


def accessed(importance: Column) -> Column:
    return F.least(F.lit(1.0), importance + BOOST)


def recall(memories: DataFrame, text_score: Column, importance: Column, days: Column, limit: int, compat: bool = False, digits: int | None = None) -> DataFrame:
    """memories by weighted text match, importance and recency. compat: a better text match counts for less. digits: scores
    are rounded to so many before they are put in order, so that those that are equal then go by id."""
    text = 1 - text_score if compat else text_score
    score = WEIGHTS[0] * text + WEIGHTS[1] * importance + WEIGHTS[2] * F.exp(-days / RECENCY_DAYS)
    score = score if digits is None else F.round(score, digits)
    return memories.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)


def prunable(memories: DataFrame, capacity: int, threshold: float) -> DataFrame:
    """What goes if there are more than `capacity`: the least important ones, of those below the threshold."""
    n = memories.count()
    return memories.where(F.col("importance") < threshold).orderBy("importance", "id").limit(max(0, n - capacity))


def _note_words(memories: DataFrame) -> tuple[DataFrame, Column]:
    """Notes (doc, content[, category]), and their words; those of different categories have nothing in common."""
    docs = memories.select(F.col("id").alias("doc"), "content", *(["category"] if "category" in memories.columns else []))
    terms = words(F.col("content"))
    if "category" in memories.columns:
        terms = F.transform(terms, lambda w: F.concat_ws(":", F.coalesce("category", F.lit("")), w))
    return docs, terms


def duplicates(memories: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, n_links, class_id) of notes (id, content[, category]): the others with alike words, within a category where there
    is one, and the least id that such links reach."""
    return similar_classes(*_note_words(memories), threshold).withColumnRenamed("doc", "id")


def merged(old: dict[str, Column], new: dict[str, Column]) -> dict[str, Column]:
    """Two notes (content, tags, files, importance) as one: the longer text, the old one's if they are of one length, all
    tags and files, and an importance of 0.05 above the greater one."""
    both = {x: F.array_union(*(F.coalesce(side[x], F.array()) for side in (old, new))) for x in ("tags", "files")}
    content = F.when(F.length(new["content"]) > F.length(old["content"]), new["content"]).otherwise(F.coalesce(old["content"], new["content"]))
    return {"content": content, **both, "importance": F.least(F.lit(1.0), F.greatest(old["importance"], new["importance"]) + 0.05)}


def created(notes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Notes (id, category, content, importance, tags, files) created in order of id, alike ones as one.

    Of notes of one category whose words are alike the least id stays, with the longest text, all tags and files, and for
    each note merged into it an importance of 0.05 above the greater one and 0.1 for the access. A chain of likeness is one
    note here, whatever the order; the merge of one at a time depends on it.
    """
    text = F.when(F.length("content") > 50_000, F.concat(F.substring("content", 1, 50_000), F.lit("... [truncated]"))).otherwise(F.col("content"))
    full = notes.withColumn("content", text).withColumn("tags", F.slice("tags", 1, 50)).withColumn("importance", F.coalesce("importance", default_importance(F.col("category"))))
    rows = full.join(duplicates(full, threshold).select("id", F.col("class_id").alias("_to")), "id")
    longest = F.max_by("content", F.struct(F.length("content"), -F.col("id")))
    boost = F.least(F.lit(1.0), F.max("importance") + (F.count("*") - 1) * (0.05 + BOOST))
    out = rows.groupBy(F.col("_to").alias("id")).agg(
        F.min_by("category", "id").alias("category"), longest.alias("content"), boost.alias("importance"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"),
        F.array_distinct(F.flatten(F.collect_set("files"))).alias("files"), (F.count("*") - 1).alias("merges"),
    )
    return out


def fact_counts(facts: DataFrame, kind: str, session: str) -> DataFrame:
    """(kind, n, sessions, chars) of facts (kind, session, text)."""
    return facts.groupBy(kind).agg(F.count("*").alias("n"), F.countDistinct(session).alias("sessions"), F.sum(F.length("text")).alias("chars"))


# --- decisions


def decided(decisions: DataFrame, action: str, id_: int, by: int | None = None) -> DataFrame:
    """Decisions (id, status, superseded_by) after one is superseded (by another), reversed (active ones only) or reactivated
    (others only); what may not change stays as it is."""
    me = F.col("id") == id_
    rules = {
        "supersede": (F.lit(True), "superseded", F.lit(by).cast("long")), "reverse": (F.col("status") == "active", "reversed", F.col("superseded_by")),
        "reactivate": (F.col("status").isin("reversed", "superseded"), "active", F.lit(None).cast("long")),
    }
    may, status, successor = rules[action]
    hit = me & may
    return decisions.withColumn("superseded_by", F.when(hit, successor).otherwise(F.col("superseded_by"))).withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def trimmed(decisions: DataFrame, capacity: int) -> DataFrame:
    """At most about `capacity` decisions (id, status, decided_at): the oldest that are not active go first; active ones
    only if there are no others."""
    n, idle = decisions.agg(F.count("*"), F.count_if(F.col("status") != "active")).first()
    if n <= capacity:
        return decisions
    from_ = decisions.where("status <> 'active'") if idle else decisions
    gone = from_.orderBy("decided_at", "id").limit(n - capacity).select("id")
    return decisions.join(gone, "id", "left_anti")


def context_lines(decisions: DataFrame, width: int = 60) -> DataFrame:
    """(place, line) of active decisions, the newest first: number, first tag, title and the start of the rationale."""
    short = F.when(F.length("rationale") > width, F.concat(F.substring("rationale", 1, width - 3), F.lit("..."))).otherwise(F.col("rationale"))
    place = F.row_number().over(Window.orderBy(F.desc("decided_at"), "id"))  # of the active ones, which a capacity bounds
    tag = F.when(F.size("tags") > 0, F.concat(F.lit("["), F.get("tags", F.lit(0)), F.lit("] "))).otherwise("")
    active = decisions.where("status = 'active'").withColumn("place", place)
    return active.select("place", F.concat(F.col("place").cast("string"), F.lit(". "), tag, "title", F.lit(" \u2014 "), short).alias("line"))


# --- sharing

# Categories of notes that are shared.
SHARED = ("architecture", "convention", "decision", "gotcha", "lesson_learned", "dependency", "workflow")


def plain(text: Column) -> Column:
    return F.lower(F.trim(text))


def shared_key(kind: str, rows: DataFrame) -> Column:
    return {"memory": lambda: F.concat(F.col("category"), F.lit(":"), plain(F.col("content"))), "decision": lambda: plain(F.col("title")), "rule": lambda: F.concat(F.col("type"), F.lit(":"), plain(F.col("name")))}[kind]()


def synced(kind: str, here: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a sync leaves on this side, and its counts (imported, exported).

    Notes of shared categories, decisions or rules that are only there come in; a decision known on both sides takes the
    other side's status. Everything shared is then exported: what is new or different to the other side is counted.
    """
    if kind == "memory":
        here, there = here, there.where(F.col("category").isin(*SHARED))
    keyed = [rows.withColumn("_k", shared_key(kind, rows)) for rows in (here, there)]
    mine, theirs = keyed[0], keyed[1].dropDuplicates(["_k"])
    new = theirs.join(mine.select("_k"), "_k", "left_anti")
    changed = None
    if kind == "decision":
        other = theirs.select("_k", F.col("status").alias("_s"))
        mine = mine.join(other, "_k", "left")
        changed = mine.where("_s IS NOT NULL AND _s <> status")
        mine = mine.withColumn("status", F.coalesce("_s", "status")).drop("_s")
    after = mine.unionByName(new, allowMissingColumns=True)
    out = after.where(F.col("category").isin(*SHARED)) if kind == "memory" else after
    known = ["_k", "status"] if kind == "decision" else ["_k"]
    exported = out.join(keyed[1].select(*known).distinct(), known, "left_anti").agg(F.count("*").alias("exported"))
    imported = new.select("_k") if changed is None else new.select("_k").unionAll(changed.select("_k"))
    counts = imported.agg(F.count("*").alias("imported")).join(exported, F.lit(True))  # one row each
    return after.drop("_k"), counts.select(F.lit(kind).alias("kind"), "imported", "exported")


def checksum(rows: DataFrame, order: list[str]) -> DataFrame:
    """(checksum): 16 hex digits over the rows' JSON, whatever their order. Digests are combined by addition and exclusive
    or, so that no task holds more than a few numbers."""
    h = F.sha2(F.to_json(F.struct(*order)), 256)
    part = lambda i: F.conv(F.substring(h, 15 * i + 1, 15), 16, 10).cast("long")
    parts = rows.select(*(part(i).alias(f"p{i}") for i in range(4)))
    sums = [F.coalesce(F.bit_xor(f"p{i}"), F.lit(0)) for i in range(4)] + [F.coalesce(F.sum(F.col("p0") % 1_000_003), F.lit(0)), F.count("*")]
    return parts.agg(F.substring(F.sha2(F.concat_ws(":", *(x.cast("string") for x in sums)), 256), 1, 16).alias("checksum"))


# --- learned rules


RULE_KINDS = ("layer", "alias", "convention", "pattern")


def taught(rules: DataFrame, kind: str, name: str, pattern: str | None = None, weight: int = 3, target: str | None = None) -> DataFrame:
    """Rules (kind, name, pattern, target, weight, used) with one more, or with a new form of it. Patterns must compile."""
    import re

    if kind not in RULE_KINDS:
        raise ValueError(f"no such kind of rule: {kind}")
    if pattern is not None:
        re.compile(pattern)
    row = rules.sparkSession.createDataFrame([(kind, name, pattern, target, max(1, min(5, weight)), 0)], "kind string, name string, pattern string, target string, weight int, used long")
    return upsert(rules, row, ["kind", "name"], F.col("used"))


def forgotten(rules: DataFrame, name: str) -> DataFrame:
    return rules.where(F.col("name") != name)


def touched(rules: DataFrame, uses: DataFrame) -> DataFrame:
    """Rules with their uses (name) counted."""
    n = uses.groupBy("name").agg(F.count("*").alias("_n"))
    return rules.join(n, "name", "left").withColumn("used", F.col("used") + F.coalesce("_n", F.lit(0))).drop("_n").select(*rules.columns)


def listed(rules: DataFrame, kind: str | None = None) -> DataFrame:
    rules = rules if kind is None else rules.where(F.col("kind") == kind)
    return rules.orderBy(F.desc("used"), "kind", "name")


# --- sessions


def briefing(session: DataFrame, facts: DataFrame, changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(session, section, n, text): of each session (session), its facts (session, kind, at, text) by kind, the files that
    changed in it (session, path, ..) and the decisions (session, title) taken."""
    def by(df: DataFrame, section: Column, text: Column, order: Column) -> DataFrame:
        rows = df.join(session.select("session"), "session", "left_semi").select("session", section.alias("section"), order.alias("o"), text.alias("t"))
        return rows.groupBy("session", "section").agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_set(F.struct("o", "t"))), 1, 20), lambda x: x["t"]), "; ").alias("text"))

    return by(facts, F.col("kind"), F.substring("text", 1, 80), F.col("at").cast("string")).unionAll(by(changes, F.lit("files"), F.col("path"), F.col("path"))).unionAll(by(decisions, F.lit("decisions"), F.col("title"), F.col("title")))


def memory_stats(memories: DataFrame) -> DataFrame:
    """(category, n, mean importance, first, last, accesses), a row for each category and one for all (category null)."""
    return memories.groupingSets([[F.col("category")], []], F.col("category")).agg(F.count("*").alias("n"), F.avg("importance").alias("importance"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("accesses"))


def taught(rules: DataFrame, kind: str, name: str, pattern: str | None = None, weight: int = 3, target: str | None = None) -> DataFrame:
    """Rules (kind, name, pattern, target, weight, used) with one more, or with a new form of it. Patterns must compile."""
    import re

    if kind not in RULE_KINDS:
        raise ValueError(f"no such kind of rule: {kind}")
    if pattern is not None:
        re.compile(pattern)
    row = rules.sparkSession.createDataFrame([(kind, name, pattern, target, max(1, min(5, weight)), 0)], "kind string, name string, pattern string, target string, weight int, used long")
    return upsert(rules, row, ["kind", "name"], F.col("used"))


def forgotten(rules: DataFrame, name: str) -> DataFrame:
    return rules.where(F.col("name") != name)


def touched(rules: DataFrame, uses: DataFrame) -> DataFrame:
    """Rules with their uses (name) counted."""
    n = uses.groupBy("name").agg(F.count("*").alias("_n"))
    return rules.join(n, "name", "left").withColumn("used", F.col("used") + F.coalesce("_n", F.lit(0))).drop("_n").select(*rules.columns)


def listed(rules: DataFrame, kind: str | None = None) -> DataFrame:
    rules = rules if kind is None else rules.where(F.col("kind") == kind)
    return rules.orderBy(F.desc("used"), "kind", "name")


# --- sessions


def briefing(session: DataFrame, facts: DataFrame, changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(session, section, n, text): of each session (session), its facts (session, kind, at, text) by kind, the files that
    changed in it (session, path, ..) and the decisions (session, title) taken."""
    def by(df: DataFrame, section: Column, text: Column, order: Column) -> DataFrame:
        rows = df.join(session.select("session"), "session", "left_semi").select("session", section.alias("section"), order.alias("o"), text.alias("t"))
        return rows.groupBy("session", "section").agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_set(F.struct("o", "t"))), 1, 20), lambda x: x["t"]), "; ").alias("text"))

    return by(facts, F.col("kind"), F.substring("text", 1, 80), F.col("at").cast("string")).unionAll(by(changes, F.lit("files"), F.col("path"), F.col("path"))).unionAll(by(decisions, F.lit("decisions"), F.col("title"), F.col("title")))


def memory_stats(memories: DataFrame) -> DataFrame:
    """(category, n, mean importance, first, last, accesses), a row for each category and one for all (category null)."""
    return memories.groupingSets([[F.col("category")], []], F.col("category")).agg(F.count("*").alias("n"), F.avg("importance").alias("importance"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("accesses"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: Column) -> DataFrame:
    """A new snapshot: new rows replace old ones of their key, of several new ones the last by order stays."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).where("_r = 1").drop("_r")
    return old.join(last.select(*key), key, "left_anti").unionByName(last)
