"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far to trust each, a posterior decides.

Features come from one Arrow pass over whole texts. Votes are plain column expressions. The vote patterns of all
documents are counted (at most 3^rules rows, whatever the corpus). Expectation-maximisation on that table estimates
each rule's accuracy: its error rate on good texts, and its recall on those that are bad. As texts are bad in several
ways and break few rules each, the bad class is a mixture with one part for each rule. The posterior of a document is
again a column expression over its votes.

Edge cases: a null or empty text has no words, all features are 0 and it fails the base test. Rows are judged one by
one, so repeated rows and null ids are judged like any other. An empty table leaves the accuracies at their priors.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, cut, fresh, slices

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_text_lines", "n_distinct")
_SYMBOLS, _UPPER, _MARKS = b"#*$%&|<>", bytes(range(65, 91)), b"!?"


def features_of(text: bytes) -> tuple[int, ...]:
    """FEATURES of a text, in their order; words are runs of anything but ASCII white space."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text) - len(text.translate(None, _SYMBOLS)), 0, 0, 0, 0, 0, 0)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        until = 0  # end of what is counted so far
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeat += i + 3 - max(i, until)
                until = i + 3
    return (
        n, chars, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat,
        len(joined) - len(joined.translate(None, _UPPER)), len(joined) - len(joined.translate(None, _MARKS)), len(lines), len(set(words)),
    )


def with_features(docs: DataFrame, prefix: str = "") -> tuple[DataFrame, dict[str, str]]:
    """docs with the features appended, and the names that they got (clashing names are moved aside)."""
    names = dict(zip(FEATURES, fresh(docs, *(prefix + x for x in FEATURES)), strict=True))
    schema = docs.select("*", *(F.lit(0).cast("long").alias(x) for x in names.values())).schema

    def run(batches):
        for batch in slices(batches):
            rows = [features_of(x or b"") for x in column_of(batch, "text", "binary")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], [*batch.schema.names, *names.values()])

    return docs.mapInArrow(run, schema), names


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1) where the share is over `bad`, good (1) where it is at most `good`, else abstains (0), as it does
    on texts of fewer than `least` words."""

    name: str
    part: str
    whole: str
    bad: float
    good: float
    inverse: bool = False
    least: int = 10

    def vote(self, f: dict[str, Column]) -> Column:
        share = f[self.part] / F.greatest(f[self.whole], F.lit(1))
        if self.inverse:
            return F.when(f["n_words"] < self.least, 0).when(share < self.bad, -1).when(share >= self.good, 1).otherwise(0)
        return F.when(f["n_words"] < self.least, 0).when(share > self.bad, -1).when(share <= self.good, 1).otherwise(0)


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.10, 0.02),
    Rule("repeated windows", "n_repeat_words", "n_words", 0.30, 0.20, least=40),
    Rule("repeated lines", "n_dup_lines", "n_text_lines", 0.34, 0.25, least=40),
    Rule("capitals", "n_upper", "word_chars", 0.30, 0.15),
    Rule("exclamation", "n_marks", "n_words", 0.30, 0.10),
    Rule("few distinct words", "n_distinct", "n_words", 0.25, 0.40, inverse=True),
    Rule("long words", "word_chars", "n_words", 12.0, 9.0),
)


@dataclass(frozen=True)
class Trust:
    """What EM found. Class 0 are good texts, class 1 + j those that are bad in the way that rule j looks for.

    shares: of the classes. bad: for each class, how often each rule, if it doesn't abstain, votes bad there; of
    class 0 these are the rules' error rates, of class 1 + j at j that rule's recall.
    """

    shares: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]

    def log_ratios(self) -> list[tuple[float, list[tuple[float, float]]]]:
        """For each bad class, against good: of the share, and of each rule's bad and good vote."""
        return [
            (math.log(w / self.shares[0]), [(math.log(b / e), math.log((1 - b) / (1 - e))) for b, e in zip(row, self.bad[0], strict=True)])
            for w, row in zip(self.shares[1:], self.bad[1:], strict=True)
        ]

    def given(self, votes: tuple[int, ...]) -> list[float]:
        """Probability of each class."""
        odds = [1.0] + [math.exp(min(500.0, z + sum(x[0] if v < 0 else x[1] if v > 0 else 0.0 for v, x in zip(votes, parts, strict=True)))) for z, parts in self.log_ratios()]
        return [x / sum(odds) for x in odds]

    def table(self, spark: SparkSession, code: str, posterior: str) -> DataFrame:
        """The posterior of every vote pattern there can be: 3^rules rows, so it may be broadcast."""
        patterns = list(product((-1, 0, 1), repeat=len(self.bad[0])))
        return spark.createDataFrame([(i, self.given(v)[0]) for i, v in enumerate(patterns)], f"`{code}` int, `{posterior}` double")


def expectation_maximisation(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 200) -> Trust:
    """Rules are independent given the class. Beta priors of fixed weight, as of 200 good texts that seldom get a bad vote and
    of 20 texts bad in a rule's way of which it finds most; a large table's own counts outweigh them. Only a rule's recall on
    texts that no other rule marks can't be told from votes, and stays near its prior."""
    total = sum(patterns.values())
    trust = Trust((0.86, *[0.14 / max(1, n_rules)] * n_rules), ((0.003,) * n_rules, *(tuple(0.9 if k == j else 0.1 for k in range(n_rules)) for j in range(n_rules))))
    for _ in range(rounds):
        mass = [0.0] * (n_rules + 1)
        voted, said_bad = ([[0.0] * n_rules for _ in mass] for _ in range(2))
        for votes, n in sorted(patterns.items()):
            for c, p in enumerate(trust.given(votes)):
                mass[c] += p * n
                for k, v in enumerate(votes):
                    if v:
                        voted[c][k] += p * n
                        said_bad[c][k] += p * n * (v < 0)
        def rate(c, k):
            prior, weight = (0.003, 200) if c == 0 else (0.9, 20) if c == k + 1 else (0.1, 5)
            return min(0.98, max(0.0005, (said_bad[c][k] + prior * weight) / (voted[c][k] + weight)))

        new = Trust(tuple((m + (8.6 if c == 0 else 1.4 / n_rules)) / (total + 10) for c, m in enumerate(mass)), tuple(tuple(rate(c, k) for k in range(n_rules)) for c in range(n_rules + 1)))
        change = max(abs(a - b) for a, b in zip((*new.shares, *sum(new.bad, ())), (*trust.shares, *sum(trust.bad, ())), strict=True))
        trust = new
        if change < 1e-7:
            break
    return trust


def _columns(names: dict[str, str]) -> dict[str, Column]:
    return {k: F.col(v) for k, v in names.items()}


def votes_of(names: dict[str, str], rules=RULES) -> list[Column]:
    return [r.vote(_columns(names)) for r in rules]


def fit(features: DataFrame, names: dict[str, str], rules=RULES) -> Trust:
    """Estimates the rules' accuracies from the vote patterns of all rows; only 3^rules counts reach the driver."""
    keys = [v.alias(f"v{i}") for i, v in enumerate(votes_of(names, rules))]
    counts = features.groupBy(*keys).count().collect()
    return expectation_maximisation({tuple(r[:-1]): r[-1] for r in counts}, len(rules))


def base_failed(names: dict[str, str]) -> Column:
    c = _columns(names)
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def with_posterior(features: DataFrame, names: dict[str, str], trust: Trust, rules=RULES, posterior: str = "posterior") -> DataFrame:
    code = fresh(features, "pattern")[0]
    number = F.lit(0)
    for v in votes_of(names, rules):  # product() counts in this order
        number = number * 3 + v + 1
    return features.withColumn(code, number.cast("int")).join(F.broadcast(trust.table(features.sparkSession, code, posterior)), code).drop(code)


def judge(docs: DataFrame, threshold: float = 0.5, rules=RULES) -> DataFrame:
    """(doc_id, features, base_failed, posterior, kept) of each row: base_failed rejects, else the posterior decides."""
    features, names = with_features(docs.select("doc_id", "text"))
    features = cut(features.drop("text"))
    out = with_posterior(features, names, fit(features, names, rules), rules)
    out = out.withColumn("base_failed", base_failed(names))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5, rules=RULES, base: bool = True) -> DataFrame:
    """The rows of docs that are kept, all columns as they were. Texts are read twice, to fit and to judge; none is shuffled."""
    slim, names = with_features(docs.select("text"))
    trust = fit(slim.drop("text"), names, rules)
    full, names = with_features(docs)
    posterior = fresh(full, "posterior")[0]
    judged = with_posterior(full, names, trust, rules, posterior).where(F.col(posterior) >= threshold)
    return (judged.where(~base_failed(names)) if base else judged).select(*docs.columns)
