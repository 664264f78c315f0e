"""Neighbourhoods and shortest paths over true facts, by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import is_atomic
from rivulet.operators.lookups import _in_context, _key
from rivulet.tables import Work, hot_keys, skew_join, union_all


def _edges(store: DataFrame, context: str | None) -> DataFrame:
    return store.filter((F.col("truth_value") == "T") & _in_context(context)).select("id", "subject", "context", "predicate", "object")


def neighbors(store: DataFrame, subject: str, depth: int = 1, context: str | None = None, outgoing_only: bool = False, atomic_only: bool = False) -> DataFrame:
    """(id, subject, context, predicate, object, depth): facts met within ``depth`` steps of a term, each quad once.

    Facts are followed in both directions unless ``outgoing_only``.  Compound
    terms are reported but not expanded (``atomic_only`` leaves them out).  A
    term without facts gives an empty result.
    """
    work = Work(store.sparkSession, "neighbors")
    edges = _edges(store, context)
    if atomic_only:
        edges = edges.filter(is_atomic("subject") & is_atomic("object"))
    ends = [F.struct(F.col("subject").alias("at"), F.col("object").alias("to"))] + ([] if outgoing_only else [F.struct(F.col("object").alias("at"), F.col("subject").alias("to"))])
    both = edges.withColumn("e", F.explode(F.array(*ends))).select("id", "subject", "context", "predicate", "object", "e.at", "e.to")
    frontier = store.sparkSession.range(1).select(F.lit(_key(subject)).alias("at"))
    visited, found = frontier, []
    for level in range(1, depth + 1):
        hit = work.put(both.join(frontier, "at", "left_semi"))
        found.append(hit.select("id", "subject", "context", "predicate", "object", F.lit(level).alias("depth")))
        if level == depth:
            break
        frontier = work.put(hit.filter(is_atomic("to")).select(F.col("to").alias("at")).distinct().join(visited, "at", "left_anti"))
        if not frontier.count():
            break
        visited = visited.unionByName(frontier)
    return union_all(found).groupBy("id", "subject", "context", "predicate", "object").agg(F.min("depth").alias("depth"))


def graph_size(edges: DataFrame) -> DataFrame:
    """(kind, n): nodes and edges of a neighbourhood."""
    nodes = edges.select(F.explode(F.array("subject", "object")).alias("n")).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), "n")
    return nodes.unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n"))


def find_path(store: DataFrame, start: str, end: str, max_depth: int = 5, context: str | None = None, outgoing_only: bool = False) -> DataFrame:
    """(hops, path): the shortest undirected path between two terms, '--p-->' between its nodes, or no row.

    ``max_depth`` counts nodes and edge labels, so the path has at most
    floor((max_depth - 1) / 2) + 1 hops.  Of equally short paths the one with
    the lowest fact ids, hop by hop, is taken.  Arrows ignore the direction of
    the fact.  A term reaches itself only over a fact that leads back.
    ``outgoing_only`` follows facts from subject to object only, between atomic
    terms.
    """
    work = Work(store.sparkSession, "path")
    a, b = _key(start), _key(end)
    edges = _edges(store, context)
    ends = [F.struct(F.col("subject").alias("at"), F.col("object").alias("to")), F.struct(F.col("object").alias("at"), F.col("subject").alias("to"))]
    if outgoing_only:
        edges, ends = edges.filter(is_atomic("subject") & is_atomic("object")), ends[:1]
    both = edges.select("id", "predicate", F.explode(F.array(*ends)).alias("e")).select("id", "predicate", "e.at", "e.to")
    front = store.sparkSession.range(1).select(F.lit(a).alias("at"), F.array(F.lit(a)).alias("path"), F.array().cast("array<bigint>").alias("ids"))
    visited = front.select("at")
    done = None
    for hop in range(1, (max_depth - 1) // 2 + 2):
        sizes = both.join(front.select("at"), "at", "left_semi").groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        hot = hot_keys(sizes, "at", "n", 10_000_000)
        step = skew_join(both, front, "at", hot, "inner", "id")
        step = step.select(F.col("to").alias("at"), F.concat("path", F.array(F.concat(F.lit("--"), F.col("predicate"), F.lit("-->")), F.col("to"))).alias("path"), F.array_append("ids", F.col("id")).alias("ids"))
        best = step.groupBy("at").agg(F.min_by(F.struct("path", "ids"), F.struct("ids", "path")).alias("b")).select("at", "b.path", "b.ids")
        best = work.put(best)
        done = best.filter(F.col("at") == b).select(F.lit(hop).alias("hops"), F.array_join("path", " ").alias("path"))
        if done.count():
            return done
        front = best.filter(is_atomic("at")).join(visited, "at", "left_anti")
        visited = visited.unionByName(front.select("at"))
    return done
