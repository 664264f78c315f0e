"""Parent-child links of unknown depth to full hierarchies.

Hash splitters cut the links into short stretches: every link's walk to the
next splitter is found by joining stretches end to end, the reduced graph
between splitters is solved by doubling, and the exact ancestors and paths are
expanded from the two.  A node with several parents is a splitter as well, so
that every walk has one way to go.  Rings without a splitter are handled apart:
a walk that meets a node twice has gone round one and is closed there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import insert_norm, present
from rivulet.tables import Work, free, hot_keys, skew_join, union_all

#: One node in so many is a splitter, on average.
SPLIT = 8
#: Links, and characters of their terms, that workers hold at most to walk them on their own.
HELD_LINKS, HELD_CHARS = 2_000_000, 1 << 26
#: Nodes from which a worker walks at once, and links that it follows at once from more than one node.
STARTS, FOLLOWED = 1024, 1 << 20


def is_splitter(c: Column) -> Column:
    """A node's own hash decides, so every worker and every run agrees."""
    return F.pmod(F.xxhash64(c, F.lit("splitter")), F.lit(SPLIT)) == 0


def links(hierarchy: DataFrame) -> DataFrame:
    """Direct links (child, parent), distinct, in insert normalisation.

    A row with depth 1 or null depth is a direct link; rows with an empty or
    null side and links from a term to itself are none.
    """
    d = hierarchy.filter("depth is null or depth = 1").select(insert_norm("child").alias("child"), insert_norm("ancestor").alias("parent"))
    return d.filter(present("child") & present("parent") & (F.col("child") != F.col("parent"))).distinct()


def _hot(rows: DataFrame, key: str, total: int) -> list:
    return hot_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "n", total)


def _walks(work: Work, up: DataFrame, several: DataFrame | None, total: int) -> DataFrame:
    """(node, path, last, ring): of every link the nodes from its parent to the next splitter or root, in order.

    Each round joins the walks that are still open with those that begin where
    they stand, so their length doubles.  ``ring`` marks the walks that went
    round a ring without splitters; their path has each node once.
    """
    rows = up.select(F.col("child").alias("node"), F.array("parent").alias("path"), F.col("parent").alias("last"), (~is_splitter(F.col("parent"))).alias("open"), F.lit(False).alias("ring"))
    where, no = work.path(), 0  # one table of all rounds: a walk stands as it closed, or as the last round left it
    while True:
        every = work.append(rows.withColumn("no", F.lit(no)), where)
        walking = every.filter(F.col("open") & (F.col("no") == no)).drop("no")
        size = walking.count()
        if not size:
            return every.filter("not open").drop("open", "no")
        onward = every.filter((~F.col("open") | (F.col("no") == no)) & ~is_splitter(F.col("node"))).drop("no")
        no += 1
        if several is not None:
            onward = onward.join(several.withColumnRenamed("child", "node"), "node", "left_anti")
        onward = onward.select(F.col("node").alias("last"), F.col("path").alias("more"), F.col("last").alias("then"), F.col("open").alias("still"), F.col("ring").alias("round"))
        j = skew_join(walking, onward, "last", _hot(walking, "last", size), "left", "node")
        met = F.col("more").isNotNull()
        j = j.select("node", F.when(met, F.concat("path", "more")).otherwise(F.col("path")).alias("whole"), F.coalesce("then", "last").alias("last"), F.coalesce("still", F.lit(False)).alias("still"), F.coalesce("round", F.lit(False)).alias("round"))
        j = j.withColumn("path", F.array_distinct("whole"))
        ring = F.col("round") | (F.size("path") < F.size("whole"))
        rows = j.select("node", "path", "last", (F.col("still") & ~ring).alias("open"), ring.alias("ring"))


def closure(hierarchy: DataFrame) -> DataFrame:
    """(child, ancestor, depth): every pair reached over one or more direct links, with the least depth.

    A node on a ring reaches itself.  A child with several parents reaches the
    ancestors of each.  No depth limit.  An empty table gives an empty result.
    """
    spark = hierarchy.sparkSession
    work = Work(spark, "trees")
    up = work.put(links(hierarchy))
    parents = up.groupBy("child").agg(F.count(F.lit(1)).alias("n"))
    total, most = parents.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    several = work.put(parents.filter("n > 1").select("child")) if most > 1 else None
    walks = _walks(work, up, several, total)

    def stops(c: str) -> Column:
        return is_splitter(F.col(c)) | (F.lit(False) if several is None else F.coalesce(F.col(f"{c}_several"), F.lit(False)))

    if several is not None:
        for c in ("node", "last"):
            walks = walks.join(several.select(F.col("child").alias(c), F.lit(True).alias(f"{c}_several")), c, "left")
        walks = work.put(walks)

    # reduced graph: splitter to splitter, closed by doubling
    ends = walks.filter(~F.col("ring") & stops("last")).select("node", F.col("last").alias("s"), F.size("path").alias("d0"), stops("node").alias("own"))
    near = ends.filter("own").select(F.col("node").alias("s"), F.col("s").alias("t"), F.col("d0").alias("d"))
    reach = work.put(near.groupBy("s", "t").agg(F.min("d").alias("d")))
    sums = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum("d")).first())
    size = sums(reach)
    while size[0]:
        ab = reach.select("s", F.col("t").alias("m"), F.col("d").alias("d1"))
        bc = reach.select(F.col("s").alias("m"), "t", F.col("d").alias("d2"))
        longer = skew_join(ab, bc, "m", _hot(ab, "m", size[0]), "inner", "s").select("s", "t", (F.col("d1") + F.col("d2")).alias("d"))
        grown = work.put(reach.unionByName(longer).groupBy("s", "t").agg(F.min("d").alias("d")))
        # a shorter way may still come up after the last new pair, but only in graphs with several parents
        now = sums(grown)
        work.drop(reach)
        reach = grown
        if now == size:
            break
        size = now

    # expansion: a node's ancestors are those passed, and those passed from every splitter that it reaches
    to = ends.select("node", "s", "d0")
    far = skew_join(to, reach, "s", _hot(to, "s", total), "inner", "node").select("node", F.col("t").alias("s"), (F.col("d0") + F.col("d")).alias("d0"))
    heads = work.put(to.unionByName(far).groupBy("node", "s").agg(F.min("d0").alias("d0")))
    between = walks.filter(stops("node")).select(F.col("node").alias("s"), "path")
    tails = skew_join(heads, between, "s", _hot(heads, "s", max(heads.count(), 1)), "inner", "node")
    passed = walks.select("node", F.lit(0).alias("d0"), "path").unionByName(tails.select("node", "d0", "path"))
    pairs = passed.select("node", "d0", F.posexplode("path").alias("i", "at")).groupBy("node", "at").agg(F.min(F.col("d0") + F.col("i") + 1).alias("d"))
    return pairs.select(F.col("node").alias("child"), F.col("at").alias("ancestor"), F.col("d").alias("depth"))


class Held(NamedTuple):
    """Links by number: those of node i lead to ``to[first[i]:first[i + 1]]``."""

    names: pa.Array
    first: np.ndarray
    to: np.ndarray


def _held(up: DataFrame, down: bool) -> Held | None:
    """``up`` (child, parent) from child to parent or ``down``; None where it is too much for one worker."""
    n, chars = up.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("child") + F.length("parent")), F.lit(0))).first()
    if n > HELD_LINKS or chars > HELD_CHARS:
        return None
    t = up.toArrow()
    terms = pa.chunked_array([x.cast(pa.string()) for c in ("child", "parent") for x in t[c].chunks], pa.string()).combine_chunks().dictionary_encode()
    at = terms.indices.to_numpy(zero_copy_only=False)
    a, b = (at[n:], at[:n]) if down else (at[:n], at[n:])
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(terms.dictionary)))])
    return Held(terms.dictionary, first.astype(np.int64), b[np.argsort(a, kind="stable")].astype(np.int64))


def _reached(held: Held, starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, node, least depth) of all that ``most`` links or fewer lead to, sorted by place of the start and node.

    Nodes that lead to too much at once are taken in halves, down to one node, which never follows a link twice.
    """
    size = len(held.names)
    front = np.arange(len(starts)) * size + starts  # place of the start and node as one number
    seen = depths = np.empty(0, np.int64)
    for depth in range(1, most + 1):
        place, node = np.divmod(front, size)
        n = held.first[node + 1] - held.first[node]
        total = int(n.sum())
        if total > FOLLOWED and len(starts) > 1:
            half = len(starts) // 2
            yield from _reached(held, starts[:half], most)
            yield from _reached(held, starts[half:], most)
            return
        links = np.arange(total) + np.repeat(held.first[node] - np.cumsum(n) + n, n)
        front = np.unique(np.repeat(place * size, n) + held.to[links])
        spot = np.searchsorted(seen, front)
        if len(seen):
            new = seen[np.minimum(spot, len(seen) - 1)] != front
            front, spot = front[new], spot[new]
        if not len(front):
            break
        seen, depths = np.insert(seen, spot, front), np.insert(depths, spot, depth)
    place, node = np.divmod(seen, size)
    yield starts[place], node, depths


def _walked(up: DataFrame, held: Held, most: int, count: bool) -> DataFrame:
    """(child, ancestor, depth) of held links, or to ``count`` them (ancestor, h): each worker walks from its own nodes,
    so nothing is shuffled."""
    sc = up.sparkSession.sparkContext
    starts = np.flatnonzero(np.diff(held.first))
    lots = -(-len(starts) // STARTS)
    shared = sc.broadcast((held, starts))

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts = shared.value
        for lot in (i for b in batches for i in b.column(0).to_pylist()):
            for start, node, depth in _reached(held, starts[lot * STARTS : (lot + 1) * STARTS], most):
                if count:
                    of, n = np.unique(start, return_counts=True)
                    yield pa.record_batch([held.names.take(pa.array(of)), pa.array(n)], ["ancestor", "h"])
                    continue
                for i in range(0, len(start), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.record_batch([held.names.take(pa.array(start[part])), held.names.take(pa.array(node[part])), pa.array(depth[part].astype(np.int32))], ["child", "ancestor", "depth"])

    tasks = max(1, min(lots, 16 * sc.defaultParallelism))
    return up.sparkSession.range(0, lots, 1, tasks).mapInArrow(walk, "ancestor string, h bigint" if count else "child string, ancestor string, depth int")


def pairs_within(up: DataFrame, most: int) -> DataFrame:
    """(child, ancestor, depth): the pairs that ``most`` links or fewer of ``up`` (child, parent; distinct) connect, with
    the least depth."""
    up = Work(up.sparkSession, "within").put(up)
    free(up.sparkSession)
    held = _held(up, False)
    if held:
        return _walked(up, held, most, False)
    pairs, names = within(up, most)
    child, ancestor = names.select(F.col("id").alias("c"), F.col("term").alias("child")), names.select(F.col("id").alias("a"), F.col("term").alias("ancestor"))
    return pairs.join(ancestor, "a").join(child, "c").select("child", "ancestor", "depth")


def counts_within(up: DataFrame, most: int) -> DataFrame:
    """(ancestor, h): of how many pairs of ``pairs_within`` a term is the ancestor, without making them a table."""
    work = Work(up.sparkSession, "within")
    up = work.put(up)
    free(up.sparkSession)
    held = _held(up, True)
    if held:
        return work.put(_walked(up, held, most, True))  # as a table its size is known to those who join it
    pairs, names = within(up, most)
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("h"))
    return n.join(names, n.a == names.id).select(F.col("term").alias("ancestor"), "h")


def within(up: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(c, a, depth) and (id, term): the pairs that ``most`` links or fewer of ``up`` (child, parent; distinct) connect,
    with the least depth and numbers for terms, and the terms of these numbers.

    Each round takes the pairs of the last one a link further, so nothing beyond ``most`` is ever made and no pair
    twice from the same parts; shuffles hold numbers only, and those of a round are freed when it is written.
    """
    spark = up.sparkSession
    work = Work(spark, "within")
    up = work.put(up)
    names = work.put(up.select(F.explode(F.array("child", "parent")).alias("term")).distinct().withColumn("id", F.monotonically_increasing_id()))
    c, p = names.select(F.col("term").alias("child"), F.col("id").alias("c")), names.select(F.col("term").alias("parent"), F.col("id").alias("a"))
    where = work.path()
    every = work.append(up.join(c, "child").join(p, "parent").select("c", "a", F.lit(1).alias("depth")), where)
    links = every.filter("depth = 1").select(F.col("c").alias("a"), F.col("a").alias("to"))
    fan = links.groupBy("a").agg(F.count(F.lit(1)).alias("f"))
    for depth in range(1, most):
        front = every.filter(F.col("depth") == depth)
        # a term with many below and many above it makes more pairs than one task should
        made = work.put(front.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(fan, "a").select("a", (F.col("n") * F.col("f")).alias("n")))
        total = made.agg(F.sum("n")).first()[0]
        if not total:
            break
        step = skew_join(front.select("c", "a"), links, "a", hot_keys(made, "a", "n", total), "inner", "c").select("c", F.col("to").alias("a"), F.lit(depth + 1).alias("depth"))
        new = every.unionByName(step).groupBy("c", "a").agg(F.min("depth").alias("depth")).filter(F.col("depth") == depth + 1)
        every = work.append(new, where)
        work.drop(made)
        del new, step, front
        free(spark)
    return every, names


def hierarchies(hierarchy: DataFrame) -> DataFrame:
    """(node, root, depth, path, descendants, kind): one row for every node and root that it leads to.

    ``path`` is a shortest way from the node to the root (node first, '→'
    between; of equally short ones the first in code point order, node by
    node) and ``depth`` its number of links; a root has itself, with depth 0.
    ``kind`` is 'tree', 'ring' for a node that reaches itself or 'to_ring' for
    a node whose way leads to a ring.  A ring has no root: ``root`` is then its
    first name in code point order.  A node with a single way up and
    one root has all of that way as its path, once round the ring where it
    leads to one; where ways part, the path is a shortest one to ``root``, of
    the node that names a ring just its name.  ``descendants`` counts the nodes below, the node itself
    left out.
    """
    spark = hierarchy.sparkSession
    work = Work(spark, "paths")
    pairs = work.put(closure(hierarchy))
    others = pairs.filter("child <> ancestor")
    on_ring = pairs.filter("child = ancestor").select(F.col("child").alias("x"))
    # a ring's nodes reach each other; its name is the first of them
    x, y = pairs.alias("x"), pairs.alias("y")
    mutual = x.join(on_ring, F.col("x.child") == F.col("x")).join(y, (F.col("x.child") == F.col("y.ancestor")) & (F.col("x.ancestor") == F.col("y.child")))
    rings = work.put(mutual.groupBy(F.col("x.child").alias("member")).agg(F.min(F.col("x.ancestor")).alias("ring")))
    nodes = pairs.select(F.explode(F.array("child", "ancestor")).alias("node")).distinct()
    roots = nodes.join(pairs.select(F.col("child").alias("node")), "node", "left_anti")

    # the ancestors of one node in order; bounded by the depth of the hierarchy, which the path itself needs
    ups = others.groupBy(F.col("child").alias("node")).agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))).alias("up"), F.max("depth").alias("high"))
    ups = nodes.join(ups, "node", "left").select("node", F.coalesce(F.transform("up", lambda u: u["ancestor"]), F.array().cast("array<string>")).alias("names"), F.coalesce("high", F.lit(0)).alias("high"))
    ups = work.put(ups.withColumn("single", F.size("names") == F.col("high")))  # one ancestor at each distance: there is one way up

    tops = union_all([
        roots.select("node", F.col("node").alias("root"), F.lit("tree").alias("kind")),
        pairs.join(roots.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select(F.col("child").alias("node"), F.col("ancestor").alias("root"), F.lit("tree").alias("kind")),
        rings.select(F.col("member").alias("node"), F.col("ring").alias("root"), F.lit("ring").alias("kind")),
        others.join(rings, others.ancestor == rings.member).select(F.col("child").alias("node"), F.col("ring").alias("root"), F.lit("to_ring").alias("kind")).distinct().join(rings.select(F.col("member").alias("node"), F.col("ring").alias("root")), ["node", "root"], "left_anti"),
    ])
    one = tops.groupBy("node").agg((F.count(F.lit(1)) == 1).alias("one"))
    tops = work.put(tops.join(ups, "node").join(one, "node").withColumn("single", F.col("single") & F.col("one")))
    way = lambda node, names: F.array_join(F.concat(F.array(node), names), "→")
    single = tops.filter("single").select("node", "root", F.col("high").alias("depth"), way(F.col("node"), F.col("names")).alias("path"), "kind")
    many = tops.filter("not single").select("node", "root", "kind")
    found = single if many.isEmpty() else single.unionByName(_shortest(work, links(hierarchy), pairs, many, ups))
    below = others.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("descendants"))
    return found.join(below, "node", "left").select("node", "root", "depth", "path", F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants"), "kind")


def _shortest(work: Work, up: DataFrame, pairs: DataFrame, many: DataFrame, ups: DataFrame) -> DataFrame:
    """(node, root, depth, path, kind) of nodes where ways part: the next hop of each pair is the first parent that is one
    link nearer, and the hops' stretches are joined end to end until they stand at the root."""
    far = pairs.filter("child <> ancestor").select(F.col("child").alias("node"), F.col("ancestor").alias("root"), "depth")
    wanted = many.join(far, ["node", "root"], "left").select("node", "root", "kind", F.coalesce("depth", F.lit(0)).alias("depth"))
    # everything that stands between a wanted node and its root
    inner = far.join(many.select("root").distinct(), "root", "left_semi")
    near = inner.select(F.col("node").alias("parent"), "root", F.col("depth").alias("left")).unionByName(many.select(F.col("root").alias("parent"), "root", F.lit(0).alias("left")).distinct())
    hop = inner.join(up.select(F.col("child").alias("node"), "parent"), "node").join(near, ["parent", "root"]).filter(F.col("left") == F.col("depth") - 1).groupBy("node", "root").agg(F.min("parent").alias("at"))
    steps = work.put(hop.select("node", "root", F.array("at").alias("way"), "at"))
    while not steps.filter("at <> root").isEmpty():
        onward = steps.select(F.col("node").alias("at"), "root", F.col("way").alias("more"), F.col("at").alias("then"))
        j = steps.join(onward, ["at", "root"], "left")
        grown = work.put(j.select("node", "root", F.when(F.col("more").isNotNull(), F.concat("way", "more")).otherwise(F.col("way")).alias("way"), F.coalesce("then", "at").alias("at")))
        work.drop(steps)
        steps = grown
    out = wanted.join(steps.select("node", "root", "way"), ["node", "root"], "left")
    names = F.coalesce("way", F.array().cast("array<string>"))
    return out.select("node", "root", "depth", F.array_join(F.concat(F.array("node"), names), "→").alias("path"), "kind")
