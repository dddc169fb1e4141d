"""Code quality: complexity, clones, security rules, layers. Functions over (doc, line_no, line) and over paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import round_half_up
from tessera.operators.text import plain_borders

# Fixed values: (severity, rule, pattern) of line rules for insecure code.
SECURITY_RULES = (
    ("critical", "hardcoded_password", r"""(?i)password\s*=\s*['"][^'"]+['"]"""),
    ("critical", "hardcoded_api_key", r"""(?i)(api_key|apikey|api_secret|secret_key)\s*=\s*['"][^'"]+['"]"""),
    ("critical", "private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("critical", "aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("high", "sql_injection", r"(query|execute|exec)\s*\([^)]*(\+|\$\{)"),
    ("high", "sql_injection_fstring", r"""(?i)f['"].*SELECT"""),
    ("high", "sql_injection_format", r"(?i)string\.Format.*SELECT"),
    ("high", "command_injection", r"(exec|system|popen|subprocess\.call|Runtime\.exec)\s*\("),
    ("high", "xss", r"innerHTML\s*=|document\.write\s*\(|dangerouslySetInnerHTML"),
    ("high", "eval_usage", r"\beval\s*\(|new\s+Function\s*\("),
    ("medium", "weak_crypto", r"\b(MD5|SHA1|DES|RC4)\b"),
    ("medium", "http_not_https", r"http:\/\/(?!localhost|127\.0\.0\.1|0\.0\.0\.0)"),
    ("medium", "hardcoded_ip", r"\b(?!127\.0\.0\.1\b)(?!0\.0\.0\.0\b)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("low", "security_todo", r"(?i)(TODO|FIXME|HACK|XXX).*(security|vuln|auth|password|encrypt)"),
    ("low", "sensitive_log", r"(?i)console\.log.*(password|token|secret|key|credential)"),
    ("low", "disabled_ssl", r"verify\s*=\s*False|NODE_TLS_REJECT_UNAUTHORIZED"),
)
SEVERITY_PENALTY = {"critical": 25, "high": 15, "medium": 8, "low": 3}
GRADES = ((90, "A"), (75, "B"), (55, "C"), (35, "D"))
# Signals (layer, weight, pattern of a path); each counts once for a path.
LAYER_SIGNALS = (
    ("controller", 2, "controller|handler|endpoint"), ("route", 2, "/routes?/|/api/"), ("service", 2, "service|usecase"), ("repository", 2, "repositor|/dao/|/store/"),
    ("model", 2, "/models?/|entit|schema"), ("view", 2, "/views?/|/pages?/|/components?/"), ("middleware", 2, "middleware|interceptor"), ("util", 1, "utils?|helpers?|/lib/"),
    ("config", 2, "config|settings|[.]ya?ml$"), ("test", 3, "/tests?/|[._](test|spec)[.]"), ("static", 1, "[.](css|png|jpg|html?)$"), ("blog", 1, "/blog/|/posts?/|/article"),
)


def any_of(rules) -> str:
    """One pattern that the lines of all rules (severity, rule, pattern) match."""
    return "|".join(f"(?i:{p.removeprefix('(?i)')})" if p.startswith("(?i)") else f"(?:{p})" for _, _, p in rules)


def security_hits(lines: DataFrame, rules=SECURITY_RULES) -> DataFrame:
    """(doc, line_no, rule, severity): each rule at most once a line; lines that are comments don't count. Every line is
    looked at once, by a test of all rules together first. Words end where ASCII letters, digits and _ do."""
    rules = [(s, r, plain_borders(p)) for s, r, p in rules]
    code = lines.where(F.col("line").rlike(any_of(rules)) & ~F.trim("line").rlike("^(//|#|[*])"))
    found = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for s, r, p in rules)), lambda x: x.isNotNull())
    return code.select("doc", "line_no", F.explode(found).alias("x")).select("doc", "line_no", "x.*")


def security_grade(hits: DataFrame) -> DataFrame:
    """(doc, score, grade) of documents with hits: 100 less each hit's penalty."""
    cost = F.lit(0)
    for name, p in SEVERITY_PENALTY.items():
        cost = F.when(F.col("severity") == name, p).otherwise(cost)
    out = hits.groupBy("doc").agg(F.greatest(F.lit(0), 100 - F.sum(cost)).alias("score"))
    grade = F.lit("F")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return out.withColumn("grade", grade)


#: What line_metrics counts, each in one pattern.
COUNTED = "[?{}]|&&|[|][|]|(?<![A-Za-z0-9_])(?:if|elif|for|foreach|while|do|case|catch|except|and|or)(?![A-Za-z0-9_])"


def line_metrics(line: Column) -> Column:
    """struct(cc, flat, open, close): what a line adds to cyclomatic complexity, to cognitive complexity besides
    nesting, and its braces. Comments and empty lines add nothing."""
    t = F.trim(line)
    skip = t.rlike("^(//|#|[*])|^$")
    has = lambda p: t.rlike(p).cast("int")
    word = lambda p: f"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])"  # noqa: E731  word borders in ASCII
    branch = has(word("if|elif")) + has(word("for|foreach|while")) + has(word("do") + "(?!\\s*[(])")
    ternary = F.regexp_count(t, F.lit("[?](?![.?=])"))
    cc = branch + has(word("case")) + has(word("catch|except")) + F.regexp_count(t, F.lit("&&|[|][|]|" + word("and|or"))) + ternary
    flat = has(word("catch|except")) + ternary
    braces = lambda c: F.regexp_count(t, F.lit(c))
    zero = lambda c: F.when(skip, 0).otherwise(c).cast("int")
    return F.struct(zero(cc).alias("cc"), zero(flat).alias("flat"), zero(branch).alias("branch"), zero(braces("[{]")).alias("open"), zero(braces("[}]")).alias("close"))


def complexity(docs: DataFrame) -> DataFrame:
    """(doc, loc, cyclomatic, cognitive, nesting) of docs (doc, text), folded over each text's lines within its row."""
    lines = F.split("text", "\n", -1)
    some = F.filter(lines, lambda x: x.rlike(COUNTED))  # the others add nothing
    rows = docs.select("doc", F.size(lines).alias("loc"), F.transform(some, line_metrics).alias("m"))
    start = "struct(1 AS cyc, 0 AS cog, 0 AS nest, 0 AS deepest)"
    step = "struct(s.cyc + x.cc AS cyc, s.cog + x.branch * (greatest(0, s.nest - x.close) + 1) + x.flat AS cog, greatest(0, s.nest - x.close) + x.open AS nest, greatest(s.deepest, greatest(0, s.nest - x.close) + x.open) AS deepest)"
    return rows.select("doc", "loc", F.expr(f"aggregate(m, {start}, (s, x) -> {step})").alias("c")).select("doc", "loc", F.col("c.cyc").alias("cyclomatic"), F.col("c.cog").alias("cognitive"), F.col("c.deepest").alias("nesting"))


def health(m: DataFrame, params: Column | None = None) -> DataFrame:
    """Adds health (1 to 10) and risk."""
    over = lambda c, n, cost: F.when(c > n, cost).otherwise(0)
    c = F.col
    cost = over(c("cyclomatic"), 10, 2) + over(c("cyclomatic"), 20, 2) + over(c("cognitive"), 15, 2) + over(c("cognitive"), 30, 2) + over(c("loc"), 100, 1) + over(c("loc"), 200, 1) + over(c("nesting"), 4, 1)
    if params is not None:
        cost = cost + over(params, 5, 1)
    score = F.greatest(F.lit(1), F.least(F.lit(10), 10 - cost))
    return m.withColumn("health", score).withColumn("risk", F.when(score >= 8, "low").when(score >= 5, "medium").when(score >= 3, "high").otherwise("critical"))


def normalized_lines(docs: DataFrame) -> Column:
    """Lines trimmed and in lower case, without blank ones, comments and lone braces."""
    return F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.lower(F.trim(x))), lambda x: ~x.rlike("^(//|#|[*])|^[{}();]*$"))


def clone_windows(docs: DataFrame, size: int = 6) -> DataFrame:
    """(window, n_places, n_docs): runs of `size` normalised lines, by hash, that occur at least twice in docs (doc, text)."""
    rows = docs.select("doc", normalized_lines(docs).alias("l"))
    at = F.when(F.size("l") >= size, F.sequence(F.lit(1), F.size("l") - size + 1)).otherwise(F.array().cast("array<int>"))
    places = rows.select("doc", "l", F.explode(at).alias("i")).select("doc", F.md5(F.array_join(F.slice("l", F.col("i"), size), "\n").cast("binary")).alias("window"))
    return places.groupBy("window").agg(F.count("*").alias("n_places"), F.countDistinct("doc").alias("n_docs")).where("n_places >= 2")


def layers(paths: DataFrame, signals=LAYER_SIGNALS) -> DataFrame:
    """(path, layer, confidence, runner_up): the layer of the highest summed weight; ties go to the one named first."""
    hits = F.filter(F.array(*(F.when(F.lower("path").rlike(p), F.struct(F.lit(w).alias("w"), F.lit(-i).alias("at"), F.lit(name).alias("layer"))) for i, (name, w, p) in enumerate(signals))), lambda x: x.isNotNull())
    best = F.sort_array(hits, asc=False)
    total = F.aggregate(best, F.lit(0), lambda s, x: s + x["w"])
    rows = paths.select("path", best.alias("b"), total.alias("t"))
    share = F.floor(F.get("b", F.lit(0))["w"] * 100 / F.col("t") + 0.5).cast("int")
    return rows.select("path", F.coalesce(F.get("b", F.lit(0))["layer"], F.lit("unknown")).alias("layer"), F.coalesce(share, F.lit(0)).alias("confidence"), F.get("b", F.lit(1))["layer"].alias("runner_up"))


def comment_density(docs: DataFrame) -> DataFrame:
    """(doc, code, comments, blank)."""
    ls = F.split("text", "\n", -1)
    n = lambda p: F.size(F.filter(ls, lambda x: F.trim(x).rlike(p)))
    return docs.select("doc", (F.size(ls) - n("^(//|#|[*]|<!--)") - n("^$")).alias("code"), n("^(//|#|[*]|<!--)").alias("comments"), n("^$").alias("blank"))


def clone_share(docs: DataFrame, size: int = 6) -> DataFrame:
    """(windows, repeated): all windows, and those that are in more than one place."""
    rows = docs.select("doc", normalized_lines(docs).alias("l")).agg(F.sum(F.greatest(F.size("l") - size + 1, F.lit(0))).alias("windows"))
    return rows.join(F.broadcast(clone_windows(docs, size).agg(F.coalesce(F.sum("n_places"), F.lit(0)).alias("repeated"))), F.lit(True))  # one row each


# --- secrets and detectors

#: Formats of secrets (severity, name, pattern): public formats of well-known services, a choice of our own. Pass your own.
SECRETS = (
    ("critical", "aws access key", "AKIA[0-9A-Z]{16}"), ("critical", "private key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("critical", "github token", "gh[pousr]_[A-Za-z0-9]{36}"),
    ("critical", "gitlab token", "glpat-[A-Za-z0-9_-]{20}"), ("critical", "stripe live key", "[rs]k_live_[A-Za-z0-9]{24}"), ("critical", "google key", "AIza[A-Za-z0-9_-]{35}"),
    ("high", "slack token", "xox[abprs]-[A-Za-z0-9-]{10,}"), ("high", "json web token", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    ("high", "password in a url", "[a-z]{3,10}://[^/@: ]{1,40}:[^/@: ]{1,40}@"), ("medium", "assigned secret", "(?i)(secret|token|passw(or)?d|api[_-]?key)[\"']?[ ]*[:=][ ]*[\"'][^\"' ]{8,}[\"']"),
)
#: Words of a line by which a secret in it is a placeholder.
PLACEHOLDERS = "(?i)example|your_|placeholder|change_?me|insert_|sample|dummy|fake|<your|xxxx|0000000|abcdef"
SECRET_PENALTY = {"critical": 25, "high": 15, "medium": 8, "low": 3}


def redacted(secret: Column) -> Column:
    tail = F.concat(F.lit("****"), F.right(secret, F.lit(4)))
    return F.when(F.length(secret) <= 12, tail).otherwise(F.concat(F.left(secret, F.lit(4)), tail))


def secrets(lines: DataFrame, rules=SECRETS, most: int = 5) -> DataFrame:
    """(doc, line_no, rule, severity, value): secrets of lines (doc, line_no, line) without placeholders, redacted; the first
    `most` of a rule in a document. Every line is looked at once, by a cheap test of all rules together first."""
    some = lines.where(F.col("line").rlike(any_of(rules)) & ~F.col("line").rlike(PLACEHOLDERS))
    hits = F.flatten(F.array(*(F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(0)), _named_hit(r, s)) for s, r, p in rules)))
    found = some.select("doc", "line_no", F.posexplode(hits).alias("at", "x")).select("doc", "line_no", "at", "x.*")
    first = F.row_number().over(Window.partitionBy("doc", "rule").orderBy("line_no", "at"))
    return found.withColumn("_r", first).where(F.col("_r") <= most).select("doc", "line_no", "rule", "severity", redacted(F.col("hit")).alias("value"))


def _named_hit(rule: str, severity: str):
    return lambda h: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), h.alias("hit"))


#: What a line of code does: (kind, form, pattern); group 1 is the method or name, group 2 the path or target.
DETECTORS = (
    ("route", "call", r"""\b(?:app|router|server|fastify)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""), ("route", "decorator", r"""@(?:\w+\.)?(get|post|put|delete|patch|Get|Post|Put|Delete|Patch)(?:Mapping)?\s*\(\s*['"]([^'"]+)['"]"""),
    ("route", "flask", r"""@(app|bp|blueprint)\.route\s*\(\s*['"]([^'"]+)['"]"""), ("middleware", "use", r"\b(app|router)\.use\s*\(\s*([\w.]+)"),
    ("api_call", "fetch", r"""\b(fetch)\s*\(\s*['"]([^'"]+)['"]"""), ("api_call", "client", r"""\b(?:axios|requests|http)\.(get|post|put|delete|patch)\s*\(\s*f?['"]([^'"]+)['"]"""),
    ("db_query", "sql", r"\b(SELECT|INSERT INTO|UPDATE|DELETE FROM)\s+(?:.*\bFROM\s+)?([A-Za-z_][\w.]*)"), ("db_query", "model", r"\b([A-Z]\w+)\.(find|findOne|findMany|create|update|destroy|aggregate)\s*\("),
)


def detected(lines: DataFrame, detectors=DETECTORS) -> DataFrame:
    """(doc, line_no, kind, form, name, target) of lines (doc, line_no, line): routes, middleware, calls and queries."""
    one = lambda k, f, p: F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(f).alias("form"), F.upper(F.regexp_extract("line", p, 1)).alias("name"), F.regexp_extract("line", p, 2).alias("target")))
    found = F.filter(F.array(*(one(*d) for d in detectors)), lambda x: x.isNotNull())
    return lines.select("doc", "line_no", F.explode(found).alias("x")).select("doc", "line_no", "x.*")


def halstead(docs: DataFrame) -> DataFrame:
    """(doc, operators, operands, volume, difficulty) of docs (doc, text): tokens, distinct ones, and the measures of them."""
    ops, names = F.regexp_extract_all("text", F.lit(r"[-+*/%=<>!&|^~?:;,.(){}\[\]]"), F.lit(0)), F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*|[0-9]+"), F.lit(0))
    rows = docs.select("doc", ops.alias("o"), names.alias("n")).select("doc", F.size("o").alias("operators"), F.size("n").alias("operands"), F.size(F.array_distinct("o")).alias("_o"), F.size(F.array_distinct("n")).alias("_n"))
    words = F.col("_o") + F.col("_n")
    volume = F.when(words > 0, (F.col("operators") + F.col("operands")) * F.log2(words.cast("double"))).otherwise(0.0)
    return rows.select("doc", "operators", "operands", volume.alias("volume"), F.when(F.col("_n") > 0, F.col("_o") / 2 * F.col("operands") / F.col("_n")).otherwise(0.0).alias("difficulty"))


def clone_groups(docs: DataFrame, size: int = 6, limit: int | None = None) -> DataFrame:
    """(window, places, docs, lines) of repeated windows of lines, without those that begin within an earlier repeated one of
    the same document (by `size` lines), the most repeated first."""
    rows = docs.select("doc", normalized_lines(docs).alias("l"))
    at = F.when(F.size("l") >= size, F.sequence(F.lit(1), F.size("l") - size + 1)).otherwise(F.array().cast("array<int>"))
    places = rows.select("doc", "l", F.explode(at).alias("i")).select("doc", "i", F.md5(F.array_join(F.slice("l", F.col("i"), size), "\n").cast("binary")).alias("window"))
    often = places.groupBy("window").agg(F.count("*").alias("n")).where("n >= 2").select("window")
    repeated = places.join(often, "window")
    kept = F.aggregate(F.array_sort(F.collect_list("i")), F.array().cast("array<int>"), lambda s, i: F.when((F.size(s) > 0) & (i < F.element_at(s, -1) + size), s).otherwise(F.concat(s, F.array(i))))
    firsts = repeated.groupBy("window", "doc").agg(kept.alias("k"))
    out = firsts.groupBy("window").agg(F.sum(F.size("k")).alias("places"), F.count("*").alias("docs")).where("places >= 2").withColumn("lines", F.col("places") * size).orderBy(F.desc("places"), "window")
    return out if limit is None else out.limit(limit)


# --- scores

# What a function, a file or a module may have at most; what the overall score weighs; grades by score.
LIMITS = {"cyclomatic": 10, "cognitive": 15, "loc": 30, "params": 4, "nesting": 3, "file_lines": 300, "file_functions": 15, "fan_out": 8}
SCORE_WEIGHTS = {"cyclomatic": 0.12, "cognitive": 0.12, "maintainability": 0.12, "modularity": 0.10, "coupling": 0.10, "security": 0.15, "documentation": 0.08, "duplication": 0.06, "solid": 0.08, "stability": 0.07}
SCORE_GRADES = ((90, "A"), (80, "A-"), (70, "B+"), (60, "B"), (50, "C+"), (40, "C"), (30, "D"))


def scores(functions: DataFrame, files: DataFrame, findings: DataFrame, shares: DataFrame) -> DataFrame:
    """One row of scores from 0 to 100: cyclomatic, cognitive, maintainability, modularity, coupling, stability, security,
    documentation, duplication, solid, health, debt (a ratio in percent), and overall with its grade.

    Of functions (cyclomatic, cognitive, loc, params, nesting, risk), files (lines, functions, fan_out, instability),
    findings (severity) and shares (documentation, duplication in percent, one row). Each part is one aggregate; a mean
    and every excess over its limit cost points.
    """
    over = lambda c, limit: F.count_if(F.col(c) > LIMITS[limit])
    mean = lambda c, default=0.0: F.coalesce(F.avg(c), F.lit(default))
    f = functions.agg(
        F.count("*").alias("n"), mean("cyclomatic").alias("cc"), over("cyclomatic", "cyclomatic").alias("cc_over"), mean("cognitive").alias("cog"), over("cognitive", "cognitive").alias("cog_over"),
        (4 * over("loc", "loc") + 5 * over("params", "params") + 5 * over("nesting", "nesting")).alias("size_cost"), F.count_if(F.col("params") > 5).alias("wide"), F.count_if(F.col("risk") != "low").alias("risky"),
    )
    g = files.agg(
        (8 * over("lines", "file_lines") + 6 * over("functions", "file_functions")).alias("file_cost"), mean("fan_out").alias("out"), over("fan_out", "fan_out").alias("out_over"),
        mean("instability", 0.5).alias("inst"), F.count_if((F.col("functions") > 20) | (F.col("lines") > 400)).alias("many_duties"),
    )
    s = findings.agg(F.count("*").alias("found"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"))
    row = f.join(g, F.lit(True)).join(s, F.lit(True)).join(shares, F.lit(True))  # one row each
    left = lambda cost: F.greatest(F.lit(0.0), 100 - cost)
    c = F.col
    parts = {
        "cyclomatic": left(5 * c("cc") + 3 * c("cc_over")), "cognitive": left(4 * c("cog") + 3 * c("cog_over")), "maintainability": left(c("size_cost")), "modularity": left(c("file_cost")),
        "coupling": left(3 * c("out") + 8 * c("out_over")), "security": left(20 * c("critical") + 5 * c("warning")), "documentation": c("documentation"), "duplication": left(5 * c("duplication")),
        "solid": left(8 * c("many_duties") + 4 * c("wide")), "stability": round_half_up(left(60 * F.abs(c("inst") - 0.5))),
    }
    row = row.select("n", "risky", "found", *(v.cast("double").alias(k) for k, v in parts.items()))
    health = 0.3 * c("cyclomatic") + 0.3 * c("cognitive") + 0.25 * c("maintainability") + 0.15 * c("modularity")
    debt = F.when(c("n") > 0, round_half_up(100 * 15 * (c("risky") + c("found")) / (30 * c("n")))).otherwise(0)
    overall = None
    for name, weight in SCORE_WEIGHTS.items():
        overall = c(name) * weight if overall is None else overall + c(name) * weight
    row = row.withColumns({"health": round_half_up(health), "debt": debt.cast("long"), "overall": round_half_up(overall)})
    grade = F.lit("F")
    for least, name in reversed(SCORE_GRADES):
        grade = F.when(c("overall") >= least, name).otherwise(grade)
    return row.select(*(round_half_up(c(k)).cast("long").alias(k) for k in parts), c("health").cast("long").alias("health"), "debt", c("overall").cast("long").alias("overall"), grade.alias("grade"))
