import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rivulet.functions.text import insert_norm_py
from rivulet.llm import canonical, terms
from rivulet.llm.canonical import Matcher, canonical_names
from rivulet.llm.terms import BurstTrie, term_frequencies
from rivulet.tables import Work


def test_trie_counts_like_a_dictionary(monkeypatch):
    monkeypatch.setattr(terms, "BURST", 4)
    r = random.Random(2)
    trie, plain = BurstTrie(), Counter()
    for _ in range(3000):
        w = "".join(r.choice("ab") for _ in range(r.randrange(0, 9)))
        trie.add(w, 2, 1)
        plain[w] += 1
    got = {p + rest: v for p, held in trie.containers() for rest, v in held.items()}
    assert got == {w: [2 * n, n] for w, n in plain.items()} and trie.size == len(plain)


def model(rows, field, rare=2, parts=20):
    occ, rec, n = Counter(), Counter(), 0
    for row in rows:
        t = insert_norm_py(row[field])
        if t:
            n += 1
            pieces = [x for x in t.replace(",", "_").split("_") if x]
            occ.update(pieces)
            rec.update(set(pieces))
    return {(field, w, occ[w], rec[w], "rare" if occ[w] <= rare else "common" if rec[w] * parts > n else None) for w in occ}


@pytest.mark.parametrize("merge", [20_000, 3])
def test_frequencies(spark, monkeypatch, merge):
    monkeypatch.setattr(terms, "MERGE", merge)
    r = random.Random(4)
    words = ["water", "Wave", "wa", "tidal", "t", "tide-pool", "x1", "", "  ", "a_b,a", None, "very__long" * 30]
    rows = [{"p": r.choice(words), "q": " ".join(str(r.choice(words)) for _ in range(3)), "field": "clash", "term": 1} for _ in range(400)]
    df = spark.createDataFrame(rows, "p string, q string, field string, term int").repartition(5)
    got = {tuple(x) for x in term_frequencies(df, ["p", "q"]).collect()}
    assert got == model(rows, "p") | model(rows, "q")


def test_frequencies_with_workers_of_unequal_size(spark, monkeypatch):
    """Two workers' tries burst below cut prefixes, the third's few terms stay in the container 'm' (and 'mo' is a term that is cut itself)."""
    monkeypatch.setattr(terms, "MERGE", 50)
    many = [{"p": f"mo{a}{b}{c}"} for a in "abcdefgh" for b in "abcdefghijkl" for c in "abcdefgh"] + [{"p": "mo"}]
    few = [{"p": w} for w in ["moaab", "moaab", "mohha", "mo", "mo", "m"]]
    df = spark.createDataFrame(many, "p string").repartition(2).union(spark.createDataFrame(few, "p string").coalesce(1))
    assert df.rdd.getNumPartitions() == 3
    got = [tuple(x) for x in term_frequencies(df, ["p"]).collect()]
    assert len(got) == len(set(got)) and set(got) == model(many + few, "p")


@pytest.mark.parametrize("same", [True, False])
def test_merges_stay_bounded_with_many_workers(spark, same):
    """500 workers with one container of 200 terms each under one letter: the same terms, or different ones."""
    rows = []
    for w in range(500):
        words = sorted({f"a{'' if same else w}x{i}" for i in range(200)})
        rows.append(("p", "a", w, words, [2] * 200, [1] * 200))
    routed = spark.createDataFrame(rows, "field string, subtree string, lot bigint, terms array<string>, occ array<bigint>, rec array<bigint>")
    work = Work(spark, "test")
    heavy = routed.groupBy("field", "subtree").agg(F.sum(F.size("terms")).alias("n"))
    largest = terms.in_lots(routed, heavy).groupBy("field", "subtree", "part").agg(F.sum(F.size("terms")).alias("n")).agg(F.max("n")).first()[0]
    assert largest <= terms.MERGE
    got = terms.merge_subtrees(routed, work).agg(F.count(F.lit(1)), F.sum("occurrences"), F.sum("records"), F.max("records")).first()
    assert tuple(got) == ((200, 200_000, 100_000, 500) if same else (100_000, 200_000, 100_000, 1))


def test_frequencies_with_few_cuts_allowed(spark, monkeypatch):
    monkeypatch.setattr(terms, "MERGE", 20)
    monkeypatch.setattr(terms, "MOST_CUTS", 2)
    rows = [{"p": f"{a}{b}{c}"} for a in "ab" for b in "abcdefgh" for c in "abcdefgh" for _ in range(2)]
    got = [tuple(x) for x in term_frequencies(spark.createDataFrame(rows, "p string").repartition(3), ["p"]).collect()]
    assert len(got) == len(set(got)) and set(got) == model(rows, "p")


def test_frequencies_empty(spark):
    assert term_frequencies(spark.createDataFrame([], "p string"), ["p"]).count() == 0
    assert term_frequencies(spark.createDataFrame([(None,), ("",), ("!",)], "p string"), ["p"]).count() == 0


LISTED = [("is_a", "is_a"), ("kind_of", "is_a"), ("part_of", "part_of"), ("uses", "uses"), ("used_for", "used_for"), ("cannot_work_without", "requires"), ("transports", "transports"), ("transport_hub_of", "hub")]


@pytest.mark.parametrize(
    ("value", "meant"),
    [
        ("IS – A", "is_a"), ("isa", "is_a"), ("iss_a", "is_a"), ("of kind", "is_a"), ("the_part_of", "part_of"), ("prat.of", "part_of"), ("UESS!", "uses"), ("trnsport", "transports"),
        ("transporting", "transports"), ("cannott_wrok_without", "requires"), ("﻿us­ed for?", "used_for"), ("transport hub of", "hub"), ("barks_at", "unmatched"), ("n/a", "unmatched"),
        ("42", "unmatched"), ("x", "unmatched"), ("part of " * 1, "part_of"), ("z" * 5000, "unmatched"), ("will transports", "transports"),
    ],
)
def test_matching(value, meant):
    hit = Matcher(LISTED).match(value)
    assert (hit[-1] if hit else "unmatched") == meant


def test_mentions_do_not_overlap():
    m = Matcher([("a_b", "1"), ("b_c_d", "2"), ("e", "3")])
    assert m.mention(("a", "b", "c", "d", "e"))[-1] == "2"


def plain_distance(a, b):
    """Slips by the textbook table: insertions, deletions, substitutions and swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_letters_in_common_and_the_bound():
    r = random.Random(7)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(2))
        assert canonical.in_common(a, b) == max(len(a), len(b)) - plain_distance(a, b)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 6)))
    listed = sorted({("_".join(word() for _ in range(r.randrange(1, 4))), "c") for _ in range(200)})
    m = Matcher(listed)
    for _ in range(200):
        ts = tuple(word() for _ in range(r.randrange(1, 4)))
        every = min(((-canonical.similarity(ts, e), o) for e, o, _ in m.entries), key=lambda x: x)
        got = m.similar(ts)
        assert (got is None and -every[0] < canonical.LEAST) or (got[1], got[3]) == every
        assert canonical.similarity(ts, ts) == 1.0 and canonical.similarity(ts, tuple(reversed(ts))) == 1.0


@pytest.mark.parametrize("block", [20_000, 3, 1])
def test_names_over_a_table(spark, block):
    """The answers do not depend on how many entries are matched at once: mentions, slips, orders and ties included."""
    rows = [(1, "is_a"), (2, "Is_A"), (3, None), (4, ""), (5, "?!"), (6, "barks_at"), (7, "KIND-OF"), (7, "KIND-OF"), (8, "usess"), (9, "the part of it"), (10, "for used"), (11, "transport hub oof"), (12, "thetransports"), (13, "gres"), (14, "used for kind of"), (15, "y" * 900)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, predicate string, value string")
    listed = [*LISTED, ("grey", "tie_b"), ("greu", "tie_a"), ("Kind Of", "is_a")]
    ref = spark.createDataFrame([*listed, LISTED[0], (None, "q"), ("q", None)], "original string, canonical string")
    found = canonical_names(df, "id", "predicate", ref, "original", "canonical", block).collect()
    got = Counter((r["entry_id"], r["canonical"], round(r["score"], 4)) for r in found)
    names = {(2, "is_a"), (6, "unmatched"), (7, "is_a"), (8, "uses"), (9, "part_of"), (10, "used_for"), (11, "hub"), (12, "transports"), (13, "tie_a"), (14, "used_for"), (15, "unmatched")}
    assert {x[:2] for x in got} == names and sum(got.values()) == 12
    whole = Counter((r["entry_id"], r["canonical"], round(r["score"], 4)) for r in canonical_names(df, "id", "predicate", ref, "original", "canonical").collect())
    assert got == whole


def test_names_empty(spark):
    ref = spark.createDataFrame([], "original string, canonical string")
    some = spark.createDataFrame([(1, "Some")], "id long, p string")
    assert [tuple(r) for r in canonical_names(some, "id", "p", ref, "original", "canonical").select("entry_id", "canonical").collect()] == [(1, "unmatched")]
    assert canonical_names(some.filter("false"), "id", "p", ref, "original", "canonical").count() == 0
