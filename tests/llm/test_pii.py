import hashlib
import random
import re
from collections import Counter

from llm_fixtures import ODD, docs, prose
from pyspark.sql import functions as F

from tessera.llm import pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10 == 0


def base(text):
    out = []
    digits = lambda s: sum(c.isdigit() for c in s)
    for k, (kind, pattern, ok) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= digits(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= digits(s) <= 15),
    ]):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)), Counter(x[2] for x in out)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(8)
    parts = ["a@b.c", "_d@e.f.g", "x@y@z.com", "é", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.000.255.10", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+44 20 7946 0958 12", "+1", " ", "😀", "-", ".", "@", "0" * 25, "79927398713000", "\n", "+", "9"]
    rows = [(i, t) for i, t, *_ in ODD] + [(100 + k, "".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(30))) for k in range(250)]
    long = [(900, "a" * 50_000 + " " + "1" * 50_000), (901, "1 " * 5_000 + "a." * 5_000 + "@b" + ".c" * 5_000), (902, "+" + "(" * 50_000 + "1.2." * 5000)]
    assert {r.doc_id: r.n_email + r.n_ip for r in pii.digests(docs(spark, long)).collect()} == {900: 0, 901: 1, 902: 2500}
    got = pii.digests(docs(spark, rows)).collect()
    want = Counter((i, hashlib.sha256(base(t)[0].encode()).hexdigest(), *(base(t)[1][k] for k in pii.KINDS)) for i, t in rows)
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    assert all(set(base(dict(rows)[r.doc_id])[0].split(",")) - {""} <= set(r.spans.split(",")) for r in got if r.doc_id not in (None, 6))


def valid_card(rng):
    head = "".join(str(rng.randrange(10)) for _ in range(15))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rng = random.Random(1)
    rows = [(i, f"{prose(i, 8)} card {valid_card(rng)} expires soon") for i in range(40)]
    bad = valid_card(rng)[:-1]
    bad += next(str(d) for d in range(10) if not luhn(bad + str(d)))
    rows += [(100, f"pay by card {bad}, expires may"), (101, f"order number {bad[::-1]} shipped"), (102, "a clean text about 2024 and nothing else")]
    got = {r.doc_id: r for r in pii.digests(docs(spark, rows).withColumn("row", F.lit("clash"))).collect()}
    at = rows[40][1].index(bad)
    assert got[100].spans == f"card:{at}:{at + 16}" and got[100].n_card == 0 and got[100].n_discovered == 1
    assert got[101].spans == "" and got[102].spans == "" and got[0].n_card == 1
    assert pii.digests(docs(spark, [])).collect() == []


def test_spaced_numbers_and_addresses_are_found_whole(spark):
    rng = random.Random(2)
    spaced = lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4))
    rows = [(i, f"{prose(i, 8)} card {spaced(valid_card(rng))} expires soon") for i in range(40)]
    rows += [(100 + i, f"{prose(i, 8)} mail hein.{i}@mail5.example.com today please") for i in range(40)]
    bad = next(c for c in (valid_card(rng)[:-1] + str(d) for d in range(10)) if not luhn(c))
    rows += [(200, f"pay by card {spaced(bad)}, expires may"), (201, "please mail jos\u00e9@mail5 today again")]
    got = {r.doc_id: r for r in pii.digests(docs(spark, rows)).collect()}
    for i, kind, what in ((200, "card", spaced(bad)), (201, "email", "jos\u00e9@mail5")):
        at = dict(rows)[i].index(what)
        assert got[i].spans == f"{kind}:{at}:{at + len(what)}" and got[i].n_discovered == 1


def invalid_card(rng):
    head = valid_card(rng)[:-1]
    return next(head + str(d) for d in range(10) if not luhn(head + str(d)))


def test_known_instances_induce_new_patterns(spark):
    """Two hops: unseen numbers beside seeds' words become known, and so do others beside words that only those have."""
    rng = random.Random(3)
    hop, far, decoy = [invalid_card(rng) for _ in range(12)], [invalid_card(rng) for _ in range(3)], [invalid_card(rng) for _ in range(20)]
    rows = [(i, f"{prose(i, 8)} card {valid_card(rng)} expires soon") for i in range(40)]
    rows += [(100 + i, f"{prose(100 + i, 5)} card {c} expires {prose(i, 3)} account {c} closed today") for i, c in enumerate(hop)]
    rows += [(200 + i, f"{prose(200 + i, 5)} account {c} closed today") for i, c in enumerate(far)]
    rows += [(300 + i, f"{prose(300 + i, 5)} parcel {c} left yesterday") for i, c in enumerate(decoy)]
    got = {r.doc_id: r.spans for r in pii.digests(docs(spark, rows)).collect()}
    text = dict(rows)
    for i, c in list(enumerate(hop, 100)) + list(enumerate(far, 200)):
        at = text[i].rindex(c)
        assert f"card:{at}:{at + 16}" in got[i].split(",")
    assert all(got[300 + i] == "" for i in range(20))  # precision: no pattern of a parcel is ever trusted


def test_contexts_are_read_whole(spark):
    rng = random.Random(4)
    blanks, word = " " * 60, "w" * 70
    rows = [(i, f"{prose(i, 4)} {word}x{blanks}{valid_card(rng)}{blanks}{word}y end") for i in range(40)]
    bad, other = invalid_card(rng), invalid_card(rng)
    rows += [(100, f"see {word}x{blanks}{bad}{blanks}{word}y end"), (101, f"see {word}z{blanks}{other}{blanks}{word}q end")]
    got = {r.doc_id: r.spans for r in pii.digests(docs(spark, rows)).collect()}
    at = dict(rows)[100].index(bad)
    assert got[100] == f"card:{at}:{at + 16}" and got[101] == ""


def test_many_matches_have_their_places(spark):
    text = " ".join(f"a{i}@b.c" for i in range(700))
    (r,) = pii.digests(docs(spark, [(1, text)])).collect()
    assert r.n_email == 700 and r.base_sha256 == hashlib.sha256(base(text)[0].encode()).hexdigest()


def test_a_text_of_a_hundred_thousand_matches(spark):
    """Work grows as the matches, not with their square: each kind's spans, words and lookups in one text of 3.5 MB."""
    import time

    n = 100_000
    text = " ".join(f"mail user{i}@ex{i % 97}.example.com now" for i in range(n))
    df = docs(spark, [(1, text), (2, "user1@ex1.example.com")])
    start = time.time()
    got = {r.doc_id: r for r in pii.digests(df).collect()}
    assert time.time() - start < 60
    assert (got[1].n_email, got[2].n_email) == (n, 1)
    spans = got[1].spans.split(",")
    at = text.index("user99999@")
    assert spans[-1] == f"email:{at}:{text.index(' ', at)}" and len(spans) == n
