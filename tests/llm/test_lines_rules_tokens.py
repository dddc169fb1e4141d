import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import ODD, docs, prose
from pyspark.sql import functions as F

from tessera.llm import line_dedup, packing, quality_rules, token_histogram
from tessera.llm.tokens import TextEncoder, WordEncoder, encoder, tokenizer_path


def lines_by_brute_force(rows):
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(held.get(key(x), ())) >= 3 and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 400_000])
def test_lines_equal_brute_force(spark, chunk):
    rng = random.Random(5)
    pool = [prose(k, 6) for k in range(12)]
    rows = [(i, t) for i, t, *_ in ODD] + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(60)]
    got = line_dedup.line_digests(docs(spark, rows).repartition(5), chunk_lines=chunk).collect()
    assert Counter(map(tuple, got)) == Counter(lines_by_brute_force(rows))


def test_lines_keep_all_columns_and_clashing_names(spark):
    df = docs(spark, ODD).withColumn("tk", F.lit("x")).withColumn("keep_bitmap", F.lit(1)).withColumn("pos", F.lit(2))
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == df.columns and got.count() == df.count()
    assert {r.text for r in got.where("doc_id = 7").collect()} == {"unique seven"}
    assert line_dedup.line_digests(docs(spark, [])).collect() == []


def rules_by_brute_force(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_rule_features_equal_brute_force(spark):
    rows = [(i, t) for i, t, *_ in ODD] + [(50 + k, "a b c d a b c " * k + "#x | <" + "\nsame line\nsame line") for k in range(20)]
    for r in quality_rules.judge(docs(spark, rows)).collect():
        want = {rules_by_brute_force(t) for i, t in rows if i == r.doc_id}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in want
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_find_junk_without_labels(spark):
    rng = random.Random(2)
    good = [(i, ". ".join(prose(1000 * i + k, 12).capitalize() for k in range(10))) for i in range(80)]
    bad = [(1000 + i, " ".join(w + rng.choice(["###", "&&&", "%%%"]) for w in prose(i, 90).split())) for i in range(10)]
    bad += [(2000 + i, " ".join(w.upper() + "!!" for w in prose(i, 90).split())) for i in range(5)] + [(3000 + i, (prose(i, 5) + " ") * 30) for i in range(5)]
    df = docs(spark, good + bad + [(9, None), (8, "")]).withColumn("n_words", F.lit("clash"))
    assert {r.doc_id for r in quality_rules.judge(df).where("kept").collect()} == {i for i, _ in good}
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {i for i, _ in good} <= {r.doc_id for r in kept.collect()} and not {i for i, _ in bad} & {r.doc_id for r in kept.collect()}
    assert quality_rules.judge(docs(spark, [])).collect() == []


def test_em_accuracies_follow_the_votes():
    trust = quality_rules.expectation_maximisation({(1, 1, 0): 80, (-1, -1, 0): 12, (1, -1, 1): 8}, 3)
    assert trust.given((1, 1, 0))[0] > 0.9 and trust.given((-1, -1, 0))[0] < 0.1 and trust.given((1, -1, 1))[0] < 0.5
    assert abs(sum(trust.shares) - 1) < 1e-9
    empty = quality_rules.expectation_maximisation({}, 3)
    assert empty.given((0, 0, 0))[0] > 0.5


def test_ids_are_the_tokenizers_own():
    path = tokenizer_path()
    texts = [(t or "").encode() for _, t, *_ in ODD] + [prose(1, 500).title().encode(), "…«Ünï» ¿Qué? ÀÉÎõü×÷ ß İI ΑΣ ς. ﬁ <|startoftext|>a <b> it's IT'S 'tis x's.".encode()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab É ñ'sS.,!<|>0 9\n\té́　漢😀") for _ in range(200)).encode() for _ in range(200)]
    fast, plain = encoder(path), TextEncoder(path)
    assert type(fast).__name__ == "WordEncoder"
    assert fast.encode(texts) == plain.encode(texts)


def test_ids_with_full_tables(monkeypatch):
    from tessera.llm import tokens

    monkeypatch.setattr(tokens, "MAX_WORDS", 30)
    monkeypatch.setattr(tokens, "MAX_STEMS", 40)
    texts = [prose(i, 60).encode() for i in range(20)]
    assert tokens.WordEncoder(tokenizer_path()).encode(texts) == TextEncoder(tokenizer_path()).encode(texts)


def check_packing(rows, got, capacity):
    plain = TextEncoder(tokenizer_path())
    want = []
    for i, t in rows:
        ids = plain.encode([(t or "").encode()])[0] + b"\0\0\0\0"
        for k, s in enumerate(range(0, len(ids) // 4, capacity)):
            part = ids[4 * s : 4 * (s + capacity)]
            want.append((i, k, s, len(part) // 4, zlib.crc32(part)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), sum(r.length for r in got)


@pytest.mark.parametrize("capacity,items", [(2048, 16_000), (64, 10)])
def test_packing_places_every_id_once(spark, capacity, items):
    rows = [(i, t) for i, t, *_ in ODD] + [(100 + k, prose(k, 3 + 7 * (k % 40))) for k in range(150)]
    got = packing.pack(docs(spark, rows).repartition(6), capacity=capacity, items=items).collect()
    bins, total = check_packing(rows, got, capacity)
    assert bins <= 1.06 * -(-total // capacity) + 1
    assert packing.pack(docs(spark, [])).collect() == []


def test_best_fit_takes_the_tightest_room():
    bins, at, fill = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(fill.tolist()) == [10, 10] and bins[0] == bins[2] and at[2] == 6


def test_small_encoder_tables_stay_small_and_pack_alike(spark):
    small = WordEncoder(tokenizer_path(), 400, 500)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}x." for k in range(150)).encode() for i in range(40)]
    for text in texts:  # 6000 words
        assert small.encode([text]) == TextEncoder(tokenizer_path()).encode([text])
        assert len(small.words) <= 400 and len(small.stems) <= 501
    df = docs(spark, [*ODD, *((100 + i, t.decode()) for i, t in enumerate(texts))])
    rows = lambda *a: sorted(map(tuple, packing.pieces_of(df, remembered=a).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    assert rows(400, 500) == rows()


def test_the_pipeline_packs_with_small_tables(spark, monkeypatch):
    import corpus_pipeline

    asked = []
    made = packing._local
    monkeypatch.setattr(packing, "_local", lambda *a: asked.append(a[-1]) or made(*a))
    corpus_pipeline.pack(spark, docs(spark, ODD), "")
    assert sum(asked[0]) <= 600_000  # 1,500,000 took an executor over 3000 MB


def test_histogram_and_its_answers(spark):
    rows = [(i, t) for i, t, *_ in ODD] + [(100 + k, prose(k, k)) for k in range(70)]
    lengths = [len(x) // 4 for x in TextEncoder(tokenizer_path()).encode([(t or "").encode() for _, t in rows])]
    sums = token_histogram.suffix_sums(token_histogram.histogram(docs(spark, rows)), block=16)
    got = {r.length: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        longer = [x for x in lengths if x > k]
        assert (r.n_longer, r.tokens_longer, r.total_truncated) == (len(longer), sum(longer), sum(min(x, k) for x in lengths))
    for limit in (0, 1, 33, 100, 10**6):
        assert token_histogram.truncated_total(sums, limit).first().tokens == sum(min(x, limit) for x in lengths)
    assert token_histogram.quantile_length(sums, 0.5).first().length == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_histogram.suffix_sums(token_histogram.histogram(docs(spark, []))).collect() == []


def test_accuracies_come_from_the_votes_not_the_priors():
    """Four rules with known error rates; three in ten texts are bad, in one way each, and other rules see some of them too.

    Rates of good texts, shares and what other rules see are found from priors of 0.003, 0.86 and 0.1. A rule's own recall
    can't be told from votes that no other rule shares, and stays near its prior.
    """
    rng, n = np.random.default_rng(8), 40_000
    error, recall = np.array([0.02, 0.004, 0.01, 0.001]), np.array([0.6, 0.95, 0.75, 0.85])
    way = np.where(rng.random(n) < 0.3, rng.integers(0, 4, n), -1)
    votes = np.where(rng.random((n, 4)) < np.where(way[:, None] == np.arange(4), recall, np.where(way[:, None] < 0, error, 0.35)), -1, 1)
    trust = quality_rules.expectation_maximisation(dict(Counter(map(tuple, votes.tolist()))), 4)
    assert abs(trust.shares[0] - 0.7) < 0.03 and np.abs(np.array(trust.bad[0]) - error).max() < 0.006
    assert all(abs(trust.bad[j + 1][k] - 0.35) < 0.1 for j in range(4) for k in range(4) if j != k)
