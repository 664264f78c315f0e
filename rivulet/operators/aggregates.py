"""Counts and reports over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import is_atomic


def stats_by_source(store: DataFrame) -> DataFrame:
    return store.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def stats_by_grade(store: DataFrame) -> DataFrame:
    """(grade_level, t, f, m): counts of each truth value, zero where none."""
    return store.groupBy("grade_level").agg(*[F.count_if(F.col("truth_value") == v).alias(v.lower()) for v in "TFM"])


def dashboard(store: DataFrame, top: int = 15) -> DataFrame:
    """(part, key, n): totals, counts per grade above 0, and the largest sources."""
    total = store.groupBy(F.col("truth_value").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("truth").alias("part"), "key", "n")
    grade = store.filter("grade_level > 0").groupBy(F.col("grade_level").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("grade").alias("part"), "key", "n")
    source = stats_by_source(store).orderBy(F.desc("n"), "source").limit(top).select(F.lit("source").alias("part"), F.col("source").alias("key"), "n")
    return total.unionByName(grade).unionByName(source)


def report(store: DataFrame) -> DataFrame:
    """One row: totals by truth value with percentages, distinct atomic subjects and distinct predicates."""
    pct = lambda v: F.coalesce(F.round(F.try_divide(F.count_if(F.col("truth_value") == v) * F.lit(100.0), F.count(F.lit(1))), 1), F.lit(0.0)).alias(f"pct_{v.lower()}")
    return store.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("truth_value") == v).alias(f"n_{v.lower()}") for v in "TFM"],
        *[pct(v) for v in "TFM"],
        F.count_distinct(F.when(is_atomic("subject"), F.col("subject"))).alias("n_subjects"),
        F.count_distinct("predicate").alias("n_predicates"),
    )


def report_parts(store: DataFrame, derived: dict[str, DataFrame], top: int = 10, counted: dict[str, DataFrame] | None = None) -> DataFrame:
    """(part, key, n): the largest sources, and how many rows each derived table has; of tables that are ``counted``
    without being made, a row with ``n`` is given."""
    out = stats_by_source(store).orderBy(F.desc("n"), "source").limit(top).select(F.lit("source").alias("part"), F.col("source").alias("key"), "n")
    for name, n in (counted or {}).items():
        out = out.unionByName(n.select(F.lit("table").alias("part"), F.lit(name).alias("key"), "n"))
    for name, table in derived.items():
        out = out.unionByName(table.agg(F.count(F.lit(1)).alias("n")).select(F.lit("table").alias("part"), F.lit(name).alias("key"), "n"))
    return out


def centrality(store: DataFrame, closure: DataFrame) -> DataFrame:
    """(subject, out_degree, in_degree, hierarchy_children, score) of every atomic term of a true fact.

    score = out + in + 2 * descendants.  The two degrees come from one scan.
    """
    return centrality_of(store, closure.groupBy("ancestor").agg(F.count(F.lit(1)).alias("h")))


def centrality_of(store: DataFrame, below: DataFrame) -> DataFrame:
    """``centrality`` where the descendants are counted already: ``below`` has ancestor, h."""
    deg = degrees(store)
    below = below.select(F.col("ancestor").alias("subject"), "h")
    h = F.coalesce("h", F.lit(0))
    return deg.join(below, "subject", "left").select("subject", "out_degree", "in_degree", h.alias("hierarchy_children"), (F.col("out_degree") + F.col("in_degree") + 2 * h).cast("double").alias("score"))


def degrees(store: DataFrame) -> DataFrame:
    """(subject, out_degree, in_degree) of every atomic term of a true fact."""
    t = store.filter("truth_value = 'T'")
    ends = t.select(F.explode(F.array(F.struct(F.col("subject").alias("term"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("term"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.filter(is_atomic("term")).groupBy(F.col("term").alias("subject")).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
