"""Token budgets: texts cut to fit, budgets by component, and context packages in three tiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.context import CHUNK, CHUNKS, CJK, CJKS, COSTLY_MARKS, MARK, OTHER

# The tail of a cut text; where a text is best cut, the best first; budgets of the tiers and components.
TAIL = "\n... [truncated]"
CUTS = (r"\n\n", r"\n}", r"\n\)", r"\n", r"\.\s", r";\s", r",\s", r"\s")
TIER_1, TIER_2 = 1250, 5000
COMPONENTS = {"graphResults": 10_000, "changeSummary": 5_000, "memoryRetrieval": 8_000, "fileContent": 15_000}
TOTAL = 50_000
LABELS = {"graphResults": "Graph Results", "changeSummary": "Change Summary", "memoryRetrieval": "Memory Retrieval", "fileContent": "File Content"}

_CHUNKS, _MARKS, _CJKS = re.compile(CHUNKS), re.compile(COSTLY_MARKS), re.compile(CJKS)


def estimate(text: str) -> int:
    """The estimate of context.estimate_tokens, of one text."""
    if len(text) <= 4:
        return int(bool(text))
    chunks = len(_CHUNKS.findall(text))
    if not chunks:
        return 0
    cjk = len(_CJKS.findall(text))
    wide = sum(c > "\x7f" for c in text) - cjk
    return max(1, int(chunks * CHUNK + len(_MARKS.findall(text)) * MARK + wide * OTHER + cjk * CJK + 0.5))


def cut_to(text: str, tokens: int, tail: str = TAIL) -> str:
    """text if it fits, else its start, cut at a good place in its second half, and the tail."""
    have = estimate(text)
    if tokens > 0 and have <= tokens:
        return text
    room = tokens - estimate(tail)
    chars = int(room * len(text) / have * 0.95) if room > 0 and have else 0
    if chars <= 0:
        return tail
    ends = ([m for m in re.finditer(p, text[:chars]) if m.start() > chars / 2] for p in CUTS)
    end = next((found[-1].end() for found in ends if found), chars)
    for _ in range(6):  # shrinks five times at most
        out = text[:end].rstrip() + tail
        if estimate(out) <= tokens or end <= 10:
            break
        end = int(end * 0.85)
    return out


def truncated(text: Column, tokens: int, tail: str = TAIL) -> Column:
    """Column form of cut_to; texts that fit are told by the native estimate and don't leave the JVM's side changed."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: cut_to(t, tokens, tail), na_action="ignore")

    return run(text)


def ratio(before: Column, after: Column) -> Column:
    """Share of tokens saved, to four places; nothing is saved of nothing."""
    return F.when(before > 0, F.floor((1 - after / before) * 10_000 + 0.5) / 10_000).otherwise(0.0)


@dataclass
class Budgets:
    """What components may use and have used, in tokens."""

    base: dict[str, int] = field(default_factory=lambda: dict(COMPONENTS))
    total: int = TOTAL

    def __post_init__(self):
        self.reset()

    def reset(self) -> None:
        self.now, self.used, self.naive = dict(self.base), dict.fromkeys(self.base, 0), 0

    def left(self, component: str | None = None) -> int:
        if component is None:
            return max(0, self.total - sum(self.used.values()))
        return max(0, self.now[component] - self.used[component])

    def record(self, component: str, what: str | int) -> None:
        self.used[component] += what if isinstance(what, int) else estimate(what)

    def enforce(self, component: str, text: str) -> str:
        room = self.left(component)
        return cut_to(text, room) if room else f"[{LABELS.get(component, component)}: budget exhausted]"

    def enforce_total(self, text: str) -> str:
        return text if estimate(text) <= self.left() else cut_to(text, self.left())

    def reallocate(self) -> None:
        """Components with more than 50 tokens to spare keep a tenth above what they used; what is free then goes in equal
        parts to those that are over their budget."""
        over = [c for c in self.now if self.now[c] < self.used[c]]
        for c in self.now:
            if self.now[c] - self.used[c] > 50:
                self.now[c] = -(-self.used[c] * 11 // 10)
        free = sum(max(0, self.now[c] - self.used[c]) for c in self.now)
        for c in over if free else ():
            self.now[c] += free // len(over)

    def report(self, spark: SparkSession) -> DataFrame:
        """(component, label, used, budget, remaining), a row for each component and one for the total."""
        rows = [(c, LABELS.get(c, c), self.used[c], self.now[c], self.left(c)) for c in self.now]
        rows.append(("total", "Total", sum(self.used.values()), self.total, self.left()))
        return spark.createDataFrame(rows, "component string, label string, used long, budget long, remaining long")

    def saved_percent(self) -> int:
        return int((1 - sum(self.used.values()) / self.naive) * 100 + 0.5) if self.naive else 0


def _lines(items: DataFrame | None, most: int) -> list[str]:
    """The first lines (order, line) whose estimates can fit: a line has a token at least, so more than `most` never do."""
    return [] if items is None else [r.line for r in items.orderBy("order").limit(most).collect()]


def package(spark: SparkSession, info: dict, symbols: DataFrame | None = None, changes: DataFrame | None = None, memories: DataFrame | None = None, decisions: DataFrame | None = None, files: DataFrame | None = None, budgets: Budgets | None = None) -> DataFrame:
    """(tier, section, tokens, budget, text): a context package.

    Tier 1 is the project (info: name, description, stack, tree, conventions, task); tier 2 are symbols, changes, notes and
    decisions, each (order, line) within its component's budget; tier 3 are files (order, path, text), in what is left.
    """
    b = budgets or Budgets()
    head = [f"# {info['name']}", info.get("description"), "Tech: " + ", ".join(info["stack"]) if info.get("stack") else None]
    for title, part in (("Structure", info.get("tree")), ("Conventions", "\n".join(f"- {x}" for x in info.get("conventions", ()))), ("Current Task", info.get("task"))):
        head += ["", f"## {title}", part] if part else []
    first = cut_to("\n".join(x for x in head if x is not None), TIER_1, "\n... [tier-1 truncated]")
    rows = [(1, "Project Overview", estimate(first), TIER_1, first)]
    for title, component, items in (("Relevant Symbols", "graphResults", symbols), ("Recent Changes", "changeSummary", changes), ("Relevant Memories", "memoryRetrieval", memories), ("Active Decisions", "memoryRetrieval", decisions)):
        room = b.left(component)
        lines = _lines(items, room)
        if lines and room:
            text = b.enforce(component, "\n".join(lines))
            b.record(component, text)
            rows.append((2, title, estimate(text), room, text))
    room = max(0, b.total - sum(r[2] for r in rows))
    if files is not None:
        for r in files.orderBy("order").limit(room // 50 + 1).toLocalIterator():
            if room <= 50:
                break
            text = b.enforce("fileContent", f"### {r.path}\n```\n{r.text}\n```")
            n = estimate(text)
            if n <= room:
                b.record("fileContent", n)
                b.naive += estimate(r.text)
                rows.append((3, r.path, n, room, text))
                room -= n
    return spark.createDataFrame(rows, "tier int, section string, tokens long, budget long, text string")
