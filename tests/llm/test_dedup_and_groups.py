import random
import re
from collections import defaultdict

import pytest

from rivulet import tables
from rivulet.llm import dedup
from rivulet.llm.components import connected_groups, synonym_groups
from rivulet.llm.dedup import facts, formatting_copies

from ..conftest import collected

SCHEMA = "id long, subject string, predicate string, object string"
TRIPLE = ["subject", "predicate", "object"]


def copies_model(rows):
    groups = defaultdict(list)
    for i, *values in rows:
        key = []
        for v in values:
            key.append(frozenset({re.sub(r"[\W_]+", "", m) for m in (v or "").lower().split(",")} - {""}))
        if i is not None and all(key):
            groups[tuple(key)].append(i)
    return {(min(g), x, len(g)) for g in groups.values() if len(g) > 1 for x in g}


CASES = [
    (1, "A b", "p", "x,y"), (2, "a-B!", "P", "y , X,,x"), (3, "ab", "p", "xy"), (4, None, "p", "x"), (5, "", "p", "x"), (6, "??", "p", "x"), (7, "ba", "p", "x,y"),
    (8, "a" * 5000, "p", "q"), (9, "A " * 5000, "p", "Q"), (10, "ab", "p", "xy"), (10, "AB", "p", "xy"), (None, "ab", "p", "xy"), (11, "É té", "p", "ß"), (12, "été", "p", "ß"), (13, "7", "٣", "x"), (14, "7.", "٣", "X"),
]


@pytest.mark.parametrize("bits", [dedup.MOST_BITS, 64])
def test_copies(spark, bits):
    """A bitmap too small to tell classes apart only costs time."""
    got = {tuple(r) for r in formatting_copies(spark.createDataFrame(CASES, SCHEMA), "id", TRIPLE, bits).collect()}
    assert got == copies_model(CASES)


def test_same_lengths_and_letters_are_not_enough(spark):
    rows = [(1, "ab", "p", "x,yz"), (2, "ba", "p", "x,yz"), (3, "a-b", "P", "zy,x"), (4, "AB", "p", "YZ x"), (5, "AB.", "p!", "yz,X"), (6, "abc", "p", "x")]
    got = {tuple(r) for r in formatting_copies(spark.createDataFrame(rows, SCHEMA), "id", TRIPLE).collect()}
    assert got == {(1, 1, 2), (1, 5, 2)} == copies_model(rows)


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(*r, 1, "k", "s") for r in CASES], SCHEMA + ", _k long, _key string, _salt string")
    assert {tuple(r) for r in formatting_copies(df, "id", TRIPLE).collect()} == copies_model(CASES)
    assert formatting_copies(spark.createDataFrame([], SCHEMA), "id", TRIPLE).count() == 0
    assert facts(spark.createDataFrame([], SCHEMA), "id", TRIPLE).count() == 0


def test_one_group_holds_a_third(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_LEAST", 10)
    monkeypatch.setattr(tables, "HOT_PARTS", 6)
    r = random.Random(5)
    rows = [(i, r.choice(["Big fact", "big-FACT", "bigfact "]), "is", "here") for i in range(200)]
    rows += [(i, f"s{r.randrange(150)}", r.choice("pq"), r.choice(["a,b", "B,a", "c"])) for i in range(200, 600)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(x) for x in formatting_copies(df, "id", TRIPLE).collect()} == copies_model(rows)
    n = {x["entry_id"]: x["n_copies"] for x in facts(df, "id", TRIPLE).collect()}
    assert n[0] == 200 and sum(n.values()) == 600


def groups_model(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a and b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return sorted(((x, find(x)) for x in list(up)), key=repr)


@pytest.mark.parametrize("kind", ["random", "chain", "star", "rings"])
def test_groups(spark, monkeypatch, kind):
    monkeypatch.setattr(tables, "HOT_LEAST", 10)
    monkeypatch.setattr(tables, "HOT_PARTS", 6)
    r = random.Random(1)
    pairs = {
        "random": [(f"t{r.randrange(90)}", f"t{r.randrange(90)}") for _ in range(70)],
        "chain": [(f"c{i}", f"c{i + 1}") for i in range(150)],
        "star": [("hub", f"s{i}") for i in range(150)] + [("hub", "s1"), ("x", "y")],
        "rings": [(f"{k}{i}", f"{k}{(i + 1) % 9}") for k in "abc" for i in range(9)],
    }[kind]
    pairs += [(None, "t1"), ("", "t2"), ("alone", "alone"), pairs[0], pairs[0][::-1]]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert collected(connected_groups(df, "a", "b")) == groups_model(pairs)


def test_groups_empty_and_normalised(spark):
    assert collected(synonym_groups(spark.createDataFrame([], "term string, synonym string"))) == []
    df = spark.createDataFrame([("B x!", "a", "q", 1), ("b-X", "C", "q", 2), ("!!", "z", "q", 3), (None, "z", "q", 4)], "term string, synonym string, rep string, v int")
    assert collected(synonym_groups(df)) == [("a", "a"), ("b_x", "a"), ("c", "a")]
