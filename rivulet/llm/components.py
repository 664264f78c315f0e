"""Groups of records linked by pairwise matches: randomised graph contraction.

In each round every vertex hooks to the neighbour (or itself) that comes first
in a fresh hash order, edges are relabelled and deduplicated, and the round's
mapping is kept; when no edge is left, the mappings are expanded backwards.
The expected number of vertices falls by a constant factor a round, so the
number of rounds grows with the logarithm of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import insert_norm, present
from rivulet.tables import Work, hot_keys, skew_join


def _hook(edges: DataFrame, round_no: int) -> DataFrame:
    """(v, rep, n): each vertex with the first of its closed neighbourhood in this round's order.

    Both directions are read from one scan; min() combines on the map side, so
    a vertex with a third of all edges costs no more than its share of rows.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")
    order = lambda c: F.struct(F.xxhash64(F.lit(round_no), c).alias("h"), c.alias("t"))
    best = both.groupBy("v").agg(F.min(order(F.col("w"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return best.select("v", F.least(F.col("m"), order(F.col("v")))["t"].alias("rep"), "n")


def connected_groups(pairs: DataFrame, left: str, right: str, max_rounds: int = 200) -> DataFrame:
    """(term, group_term): each vertex once, with the first vertex of its group in code point order.

    ``pairs`` holds one link a row in either direction.  Rows with a null or
    empty side are no links; a row that links a term to itself makes the term a
    vertex.  Repeated and reversed rows count once.  An empty table gives an
    empty result.  Vertices are compared as given (normalise before).
    """
    spark = pairs.sparkSession
    work = Work(spark, "groups")
    links = pairs.select(F.col(left).alias("x"), F.col(right).alias("y")).filter(present("x") & present("y"))
    links = work.put(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    edges = links.filter("a <> b")
    n_edges = edges.count()
    maps: list[DataFrame] = []
    owned: DataFrame | None = None
    while n_edges:
        if len(maps) >= max_rounds:
            raise RuntimeError(f"graph contraction did not end within {max_rounds} rounds")
        hook = work.put(_hook(edges, len(maps)))
        hot = hot_keys(hook, "v", "n", 2 * n_edges)
        to = hook.select("v", "rep")
        e = skew_join(edges.withColumnRenamed("a", "v"), to, "v", hot, "inner", "b").select(F.col("rep").alias("a"), "b")
        e = skew_join(e.withColumnRenamed("b", "v"), to, "v", hot, "inner", "a").select("a", F.col("rep").alias("b"))
        e = e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = work.put(e)
        n_edges = new.count()
        maps.append(to)
        work.drop(owned)
        edges, owned = new, new

    # expansion, last round first: a vertex's representative is looked up in the next round's result
    final: DataFrame | None = None
    for m in reversed(maps):
        if final is None:
            final = m
            continue
        later = final.select(F.col("v").alias("rep"), F.col("rep").alias("last"))
        sizes = m.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        total = m.count()
        hot = hot_keys(sizes, "rep", "n", total)
        up = skew_join(m, later, "rep", hot, "left", "v")
        previous = final
        final = work.put(up.select("v", F.coalesce("last", "rep").alias("rep")))
        work.drop(previous)
    alone = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    if final is None:
        return alone.select(F.col("v").alias("term"), F.col("v").alias("group_term"))
    named = work.put(final.groupBy("rep").agg(F.min("v").alias("group_term"), F.count(F.lit(1)).alias("n")))
    hot = hot_keys(named, "rep", "n", final.count())
    groups = skew_join(final, named.select("rep", "group_term"), "rep", hot, "inner", "v").select(F.col("v").alias("term"), "group_term")
    single = alone.join(final.select("v"), "v", "left_anti").select(F.col("v").alias("term"), F.col("v").alias("group_term"))
    return groups.unionByName(single)


def synonym_groups(synonyms: DataFrame) -> DataFrame:
    """``connected_groups`` over ``synonyms.term`` and ``synonyms.synonym`` in insert normalisation."""
    pairs = synonyms.select(insert_norm("term").alias("x"), insert_norm("synonym").alias("y"))
    return connected_groups(pairs, "x", "y")
