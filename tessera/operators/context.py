"""Token estimates, content types, budgets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import round_half_up

# What a chunk, a costly mark, another character and a CJK character add to the estimate; the costly marks
# and the CJK ranges.
CHUNK, MARK, OTHER, CJK = 1.3, 0.15, 0.5, 2.0
COSTLY_MARKS = r"""[{}()\[\]<>:;,."'`~!@#$%^&*+=|\\/?]"""
CJKS = r"[\u3000-\u303F\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uFF00-\uFFEF]"
CHUNKS, NON_ASCII = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", r"[^\x00-\x7F]"


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens: weighted counts of word chunks, marks, non-ASCII and CJK characters, rounded; short texts are 1.

    Each kind is counted once. Most texts have no CJK character, which one look at the non-ASCII ones tells.
    """
    n = lambda p: F.regexp_count(text, F.lit(p))
    counts = F.transform(F.array(F.struct(n(CHUNKS).alias("chunks"), n(COSTLY_MARKS).alias("marks"), F.regexp_replace(text, r"[\x00-\x7F]+", "").alias("wide"))), _weighted)
    out = F.when(text.isNull() | (text == ""), 0).when(F.length(text) <= 4, 1)
    return out.otherwise(F.get(counts, F.lit(0))).cast("long")


def _weighted(c: Column) -> Column:
    wide, cjk = F.length(c["wide"]), F.when(c["wide"] == "", 0).otherwise(F.regexp_count(c["wide"], F.lit(CJKS)))
    total = c["chunks"] * CHUNK + c["marks"] * MARK + (wide - cjk) * OTHER + cjk * CJK
    return F.when(c["chunks"] == 0, 0).otherwise(F.greatest(F.lit(1), round_half_up(total)))


def quarter_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


# Content types in the order in which they are tried, and the patterns that mark them. Those of a diff are
# looked for at the text's start, all others at any line.
CONTENT_SIGNS = {
    "diff": (r"^diff --git", r"^--- a/", r"^\+\+\+ b/", r"^@@\s+-\d+"),
    "stack_trace": (r"^\s*at\s+.+\(.+:\d+:\d+\)", r'^\s*File ".+", line \d+', r"^\s+at .+\(.*\.java:\d+\)", r"^Traceback \(most recent call last\)", r"panic:.*goroutine"),
    "test_output": (r"^(PASS|FAIL|ok|not ok|Tests:)", r"\d+ (passing|failing|passed|failed)", r"^(Test Suite|RUNS?|✓|✗|✘|●)", r"(PASSED|FAILED|ERROR)\s+\[", r"^={3,}\s*(FAILURES|ERRORS)\s*={3,}"),
    "build_log": (r"^(?i:warning|error|note)\s*:", r"^\[\d{2}:\d{2}:\d{2}\]", r"^>\s+(tsc|npm|yarn|pnpm|make|cmake|gradle|cargo|go\s+build)", r"^(BUILD|COMPILE)\s+(SUCCEEDED|FAILED)", r"error TS\d+:"),
    "json_data": (),
    "config_file": (r"^\[[\w.-]+\]\s*$", r"^[\w_][\w._-]*\s*[:=]\s*", r"^(apiVersion|kind|metadata|spec):"),
    "markdown": (r"^#{1,6}\s+.+", r"^\*{3,}$|^-{3,}$"),
    "source_code": (r"^(import|export|from|require|use|using|package|module)\s", r"^(function|class|interface|type|enum|const|let|var|def|fn|pub|func)\s", r"^(public|private|protected|static|abstract|async)\s", r"[{};]\s*$", r'^\s*(//|#|/\*|\*|""")'),
}


def _is_json(t: Column) -> Column:
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    return F.concat(first, last).isin("{}", "[]") & F.try_parse_json(t).isNotNull()


def content_type(text: Column) -> Column:
    """The first type of CONTENT_SIGNS that the stripped text has a sign of (json_data: that it parses as), else plain_text.
    Each type's signs are looked for together; lines end at newlines only."""

    def named(t: Column) -> Column:
        out = F.when(t == "", "plain_text")
        for name, signs in CONTENT_SIGNS.items():
            flags = "" if name == "diff" else "(?md)"
            out = out.when(t.rlike(flags + "|".join(f"(?:{x})" for x in signs)) if signs else _is_json(t), name)
        return out.otherwise("plain_text")

    stripped = F.array(F.regexp_replace(text, r"^\s+|\s+$", ""))  # bound once
    return F.coalesce(F.get(F.transform(stripped, named), F.lit(0)), F.lit("plain_text"))


def within_budget(items: DataFrame, order: list[Column], cost: Column, budget: int, by: list[str] | None = None) -> DataFrame:
    """The longest prefix, in order, whose cost stays within the budget; for each group of `by`, or of a bounded list."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def greedy_pack(items: DataFrame, budget: int, by: str) -> DataFrame:
    """(by, id, cost): each group's items by descending score, packed greedily: what overflows and costs over a tenth of
    the budget is skipped, the first smaller overflow ends the group. items: by, id, score, cost (positive).

    A group is streamed in order once, in constant memory, and never held as one array.
    """
    ordered = items.select(by, "id", F.col("score").cast("double").alias("score"), F.col("cost").cast("long").alias("cost"))
    schema = f"{ordered.schema[by].simpleString().replace(':', ' ', 1)}, id {ordered.schema['id'].dataType.simpleString()}, cost long"

    def run(batches):
        group, used, over, started = None, 0, False, False
        for batch in batches:
            keep = []
            for i, (g, cost) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if not started or g != group:
                    group, used, over, started = g, 0, False, True
                if over or cost is None:
                    continue
                if used + cost <= budget:
                    used += cost
                    keep.append(i)
                elif cost <= budget / 10:
                    over = True
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1, 3])

    return ordered.repartition(by).sortWithinPartitions(by, F.desc("score"), "id").mapInArrow(run, schema)
