import random
from collections import defaultdict

import numpy as np
import pytest

from rivulet import catalog
from rivulet.operators import aggregates, derived, trees

from .conftest import collected

SCHEMA = "child string, ancestor string, depth int, path string"


def model(rows):
    """Least depth of every pair, by breadth-first search."""
    up = defaultdict(set)
    for c, p in rows:
        if c and p and c != p:
            up[c].add(p)
    out = set()
    for c in list(up):
        seen, front, d = {}, {c}, 0
        while front:
            d += 1
            front = {p for x in front for p in up.get(x, ())} - seen.keys()
            seen |= dict.fromkeys(front, d)
        out |= {(c, a, d) for a, d in seen.items()}
    return sorted(out, key=repr)


def frame(spark, pairs):
    return spark.createDataFrame([(c, p, 1, None) for c, p in pairs], SCHEMA)


def test_edge_cases(spark):
    rows = [
        ("A b", "c", 1, None), ("a-B", "C!", None, "x"), ("c", "d", 1, ""), ("d", "d", 1, None), (None, "q", 1, None), ("", "q", 1, None),
        ("q", "???", 1, None), ("z", "y", 2, "wrong"), ("r1", "r2", 1, None), ("r2", "r1", 1, None), ("s", "r1", 1, None),
    ]
    got = collected(trees.closure(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted([("a_b", "c", 1), ("a_b", "d", 2), ("c", "d", 1), ("r1", "r1", 2), ("r1", "r2", 1), ("r2", "r1", 1), ("r2", "r2", 2), ("s", "r1", 1), ("s", "r2", 2)], key=repr)


def test_empty(spark):
    assert collected(trees.closure(spark.createDataFrame([], SCHEMA))) == []
    assert collected(trees.hierarchies(spark.createDataFrame([], SCHEMA))) == []


def test_splitterless_rings_and_chains(spark):
    names = [f"n{i}" for i in range(400)]
    frame_ = spark.createDataFrame([(n,) for n in names], "n string")
    split = {r["n"] for r in frame_.filter(trees.is_splitter(frame_.n)).collect()}
    plain = [n for n in names if n not in split]
    ring = plain[:11]
    pairs = list(zip(ring, ring[1:] + ring[:1]))  # a ring without any splitter
    pairs += [(plain[20], ring[3]), (plain[21], plain[20])]
    chain = names[200:280]
    pairs += list(zip(chain, chain[1:]))
    assert collected(trees.closure(frame(spark, pairs))) == model(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [(f"t{r.randrange(60)}", f"t{r.randrange(60)}") for _ in range(70)]  # several parents, rings, repeats
    assert collected(trees.closure(frame(spark, pairs))) == model(pairs)


def test_star_is_skewed(spark, monkeypatch):
    from rivulet import tables

    monkeypatch.setattr(tables, "HOT_LEAST", 20)
    monkeypatch.setattr(tables, "HOT_PARTS", 8)
    pairs = [(f"leaf{i}", "hub") for i in range(300)] + [("hub", "top"), ("top", "root")]
    assert collected(trees.closure(frame(spark, pairs))) == model(pairs)


def test_hierarchies(spark):
    got = {r["node"]: r.asDict() for r in trees.hierarchies(frame(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x")])).collect()}
    assert got["a"] | {} == {"node": "a", "root": "c", "depth": 2, "path": "a→b→c", "descendants": 0, "kind": "tree"}
    assert (got["c"]["root"], got["c"]["depth"], got["c"]["descendants"], got["c"]["kind"]) == ("c", 0, 2, "tree")
    assert (got["x"]["kind"], got["w"]["kind"], got["w"]["root"]) == ("ring", "to_ring", "x")


def test_a_path_of_real_links_for_every_root(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("z", "a"), ("d", "top"), ("e", "top"), ("k", "l"), ("l", "k"), ("k", "top"), ("m", "k"), ("m", "n")]
    got = {(r["node"], r["root"]): (r["depth"], r["path"], r["kind"]) for r in trees.hierarchies(frame(spark, pairs)).collect()}
    assert got["a", "top"] == (3, "a→b→d→top", "tree") and got["z", "top"] == (4, "z→a→b→d→top", "tree")
    two = trees.hierarchies(frame(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "e")])).collect()
    assert {(r["node"], r["root"], r["path"]) for r in two} == {("a", "d", "a→b→d"), ("a", "e", "a→c→e"), ("b", "d", "b→d"), ("c", "e", "c→e"), ("d", "d", "d"), ("e", "e", "e")}
    assert got["m", "n"] == (1, "m→n", "tree") and got["m", "top"] == (2, "m→k→top", "tree") and got["m", "k"] == (1, "m→k", "to_ring")
    assert got["k", "k"] == (0, "k", "ring") and got["l", "k"] == (1, "l→k", "ring") and got["l", "top"] == (2, "l→k→top", "tree")
    link = set(pairs)
    for _, path, _ in got.values():
        way = path.split("→")
        assert all(x in link for x in zip(way, way[1:]))


@pytest.mark.parametrize("seed", [3, 4])
def test_paths_of_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(f"t{a}", f"t{b}") for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(45)) if a != b})
    depth = {(c, a): d for c, a, d in model(pairs)}
    children = {c for c, _ in pairs}
    rows = trees.hierarchies(frame(spark, pairs)).collect()
    seen = {(x["node"], x["root"]) for x in rows}
    assert len(seen) == len(rows)
    tops = {a for c, a in depth if a not in children}
    assert {(c, a) for c, a in depth if a in tops} | {(t, t) for t in tops} == {(x["node"], x["root"]) for x in rows if x["kind"] == "tree"}
    for x in rows:
        way = x["path"].split("→")
        assert way[0] == x["node"] and all(s in pairs for s in zip(way, way[1:])) and len(way) == x["depth"] + 1
        if x["kind"] == "tree":
            assert way[-1] == x["root"] and x["depth"] == depth.get((x["node"], x["root"]), 0)
        else:
            assert (x["root"], x["root"]) in depth


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", "b", 1, None, 7, "q", "w")], SCHEMA + ", node long, at string, _salt string")
    assert collected(trees.closure(df)) == [("a", "b", 1)]


def taxonomy(spark, pairs):
    rows = [(i, c, "general", "is_a", p, "T") for i, (c, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id long, subject string, context string, predicate string, object string, truth_value string")


@pytest.mark.parametrize("most", [2, 5])
def test_a_bounded_closure_makes_nothing_beyond_its_depth(spark, monkeypatch, most):
    rnd = random.Random(most)
    pairs = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    monkeypatch.setattr(derived, "closure", None)  # without a bound
    got = collected(derived.build_hierarchy(taxonomy(spark, pairs), most))
    assert got == [r for r in model(pairs) if r[2] <= most]
    pairs_made, _ = derived.hierarchy_pairs(taxonomy(spark, pairs), most)
    assert pairs_made.count() == len(got)


def test_held_links_are_walked_without_a_join(spark, monkeypatch):
    rnd = random.Random(50)
    pairs = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(110)] + [(f"c{i}", f"c{i + 1}") for i in range(15)] + [(f"hub{i}", "n1") for i in range(40)]
    kb = taxonomy(spark, [*pairs, *pairs[:9]])
    for held in (len(pairs), 0):  # beyond the bound they are joined
        monkeypatch.setattr(trees, "HELD_LINKS", held)
        if held:
            monkeypatch.setattr(trees, "within", None)
        got = derived.build_hierarchy(kb)
        assert collected(got) == [r for r in model(pairs) if r[2] <= 10]
        assert collected(derived.descendants(kb)) == collected(got.groupBy("ancestor").count())
        monkeypatch.undo()


@pytest.mark.parametrize("followed", [1, 50, 1 << 20])
def test_walks_that_follow_too_much_at_once_are_halved(spark, monkeypatch, followed):
    rnd = random.Random(followed)
    pairs = sorted({(f"n{rnd.randrange(60)}", f"m{rnd.randrange(60)}") for _ in range(110)} | {(f"m{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(110)})
    held = trees._held(spark.createDataFrame(pairs, "child string, parent string"), False)
    monkeypatch.setattr(trees, "FOLLOWED", followed)
    names = held.names.to_pylist()
    walked = [(names[a], names[b], d) for s, n, e in trees._reached(held, np.arange(len(names)), 4) for a, b, d in zip(s.tolist(), n.tolist(), e.tolist(), strict=True)]
    assert sorted(walked, key=repr) == [r for r in model(pairs) if r[2] <= 4]


def test_centrality_counts_descendants_without_their_names(spark, monkeypatch):
    kb = taxonomy(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("x,y", "a")])
    want = collected(aggregates.centrality(kb, derived.build_hierarchy(kb)))
    monkeypatch.setattr(derived, "build_hierarchy", None)
    assert collected(aggregates.centrality_of(kb, derived.descendants(kb))) == want


def test_report_counts_the_hierarchy_without_its_names(spark, monkeypatch):
    monkeypatch.setattr(derived, "build_hierarchy", None)
    got = {(r["part"], r["key"]): r["n"] for r in catalog.kb_report_parts(spark, "/root/testdata/sf0.001").collect()}
    kb = catalog._judged(spark, "/root/testdata/sf0.001")
    assert got["table", "hierarchy"] == derived.hierarchy_pairs(kb)[0].count() > 0
