"""References to records that do not exist: a fixpoint cascade over the foreign-key graph.

Each reference is checked against its target with a semi-join; records with a
bad reference are orphans, and records that refer to an orphan are indirectly
orphaned.  The semi-joins are iterated down the graph until no new orphan
comes up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.text import insert_norm, present
from rivulet.tables import Work, hot_keys, load, skew_join, union_all


@dataclass
class Table:
    """A table of the graph: key as reported, key as referred to, creation and deletion time (or None)."""

    name: str
    rows: DataFrame
    record_key: Column
    keys: Column  # one key, or an array of all keys under which the record is found
    created: Column | None = None
    deleted: Column | None = None
    many: bool = False


@dataclass
class Reference:
    """``child`` refers to ``parent`` by ``column``; a null ``column`` is no reference."""

    child: str
    parent: str
    column: Column
    reasons: list[str] = field(default_factory=lambda: ["missing", "deleted", "late"])


def _targets(t: Table) -> DataFrame:
    """One row a key: whether it stands, when it was first created, the record's own key."""
    keys = F.explode(t.keys) if t.many else t.keys
    none = F.lit(None).cast("timestamp")
    rows = t.rows.select(keys.alias("ref"), (t.created if t.created is not None else none).alias("t_made"), (t.deleted if t.deleted is not None else none).alias("t_gone"))
    rows = rows.filter(F.col("ref").isNotNull())
    return rows.groupBy("ref").agg(F.min("t_made").alias("t_made"), F.max("t_gone").alias("t_gone"), F.lit(True).alias("t_there"))


def orphans(spark: SparkSession, tables: list[Table], references: list[Reference], max_rounds: int | None = None) -> DataFrame:
    """(table_name, record_key, ref_month, reason, via, level): every orphaned record, one row per bad reference.

    Level 1 is direct: reason 'missing' when no record has the key, else
    'deleted' when the target is deleted, else 'late' when the target was
    created after the referring record (each only where the reference lists
    it).  Level n > 1 has reason 'inherited': the target itself came out at
    level n - 1 as missing or deleted or inherited ('late' targets exist in the
    end and pass nothing on).  ``via`` is the referred table, ``ref_month`` the
    month of the referring row's creation, 'unknown' when that is null.  Rows
    that are repeated in a table come out once each.  Null references are no
    references; empty tables give no rows, or all references missing.  The
    cascade runs until no record is new; with ``max_rounds``, one that needs
    more levels is an error.
    """
    work = Work(spark, "orphans")
    by_name = {t.name: t for t in tables}
    refs: dict[int, DataFrame] = {}
    found: list[DataFrame] = []
    month = lambda t: F.coalesce(F.date_format(t.created, "yyyy-MM"), F.lit("unknown")) if t.created is not None else F.lit("unknown")
    for i, r in enumerate(references):
        child, parent = by_name[r.child], by_name[r.parent]
        made = child.created if child.created is not None else F.lit(None).cast("timestamp")
        own = child.keys if not child.many else F.lit(None).cast("string")
        cast = own.cast("string").alias("own_ref")
        rows = child.rows.select(r.column.alias("ref"), child.record_key.cast("string").alias("record_key"), cast, made.alias("made"), month(child).alias("ref_month")).filter(F.col("ref").isNotNull())
        refs[i] = rows
        targets = _targets(parent)
        sizes = rows.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
        joined = skew_join(rows, targets, "ref", hot_keys(sizes, "ref", "n", rows.count()), "left", "record_key")
        reason = F.when(F.col("t_there").isNull(), F.lit("missing") if "missing" in r.reasons else F.lit(None))
        if "deleted" in r.reasons:
            reason = reason.when(F.col("t_gone").isNotNull(), "deleted")
        if "late" in r.reasons:
            reason = reason.when(F.col("t_made") > F.col("made"), "late")
        bad = joined.withColumn("reason", reason).filter(F.col("reason").isNotNull())
        found.append(bad.select(F.lit(r.child).alias("table_name"), "record_key", "own_ref", "ref_month", "reason", F.lit(r.parent).alias("via"), F.lit(1).alias("level")))
    every = [work.put(union_all(found))]
    referred = {r.parent for r in references}
    news = every[0].filter(F.col("table_name").isin(*referred) & (F.col("reason") != "late"))
    level = 1
    # a record without a key is known by what refers to it, so that a ring of such records ends too
    named = F.coalesce(F.concat(F.lit("k"), "record_key"), F.concat(F.lit("o"), "own_ref"))
    while referred & {r.child for r in references} and not news.isEmpty():
        if max_rounds is not None and level >= max_rounds:
            raise RuntimeError(f"orphans go on below level {max_rounds}")
        level += 1
        below = []
        for i, r in enumerate(references):
            gone = news.filter(F.col("table_name") == r.parent).select(F.col("own_ref").alias("ref")).distinct()
            hit = refs[i].withColumn("ref", F.col("ref").cast("string")).join(gone, "ref", "left_semi")
            below.append(hit.select(F.lit(r.child).alias("table_name"), "record_key", "own_ref", "ref_month", F.lit("inherited").alias("reason"), F.lit(r.parent).alias("via"), F.lit(level).alias("level")))
        known = union_all(every).select("table_name", named.alias("named"))
        fresh = work.put(union_all(below).withColumn("named", named).join(known, ["table_name", "named"], "left_anti").drop("named"))
        every.append(fresh)
        news = fresh.filter(F.col("table_name").isin(*referred))
    return union_all(every).drop("own_ref")


def knowledge_base_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orphans`` over the knowledge base: examples to bridges, centrality rows to the terms of entries."""
    bridges, entries = load(spark, sf_dir, "bridges"), load(spark, sf_dir, "entries")
    term = insert_norm("subject")
    # map-side distinct terms first: the two sides of an entry in one column
    terms = entries.select(F.explode(F.array(insert_norm("subject"), insert_norm("object"))).alias("term")).filter(present("term")).distinct()
    tables = [
        Table("bridge_examples", load(spark, sf_dir, "bridge_examples"), F.col("id"), F.col("id"), F.col("created_at")),
        Table("bridges", bridges, F.col("id"), F.col("id"), F.col("created_at"), F.col("deleted_at")),
        Table("centrality", load(spark, sf_dir, "centrality"), F.col("subject"), term, F.col("created_at")),
        Table("entries", terms, F.col("term"), F.col("term")),
    ]
    references = [
        Reference("bridge_examples", "bridges", F.col("bridge_id")),
        Reference("centrality", "entries", F.when(present(term), term), ["missing"]),
    ]
    return orphans(spark, tables, references)


def star_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orphans`` down the star schema after the region ASIA was removed and the customers and suppliers with a negative
    balance were deleted: nations lose their region, and what hangs from them inherits it."""
    region, nation, customer, supplier, orders, lineitem = (load(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"))
    line = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # line numbers are not unique
    closed = lambda c: F.when(F.col(c) < 0, F.to_timestamp(F.lit("2024-01-01")))
    tables = [
        Table("region", region.filter("r_name <> 'ASIA'"), F.col("r_regionkey"), F.col("r_regionkey")),
        Table("nation", nation, F.col("n_nationkey"), F.col("n_nationkey")),
        Table("customer", customer, F.col("c_custkey"), F.col("c_custkey"), None, closed("c_acctbal")),
        Table("supplier", supplier, F.col("s_suppkey"), F.col("s_suppkey"), None, closed("s_acctbal")),
        Table("orders", orders, F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_orderdate")),
        Table("lineitem", lineitem, F.concat_ws("-", *line), F.concat_ws("-", *line), F.col("l_shipdate")),
    ]
    gone = ["missing", "deleted"]
    references = [
        Reference("nation", "region", F.col("n_regionkey"), gone), Reference("customer", "nation", F.col("c_nationkey"), gone), Reference("supplier", "nation", F.col("s_nationkey"), gone),
        Reference("orders", "customer", F.col("o_custkey"), gone), Reference("lineitem", "orders", F.col("l_orderkey"), gone), Reference("lineitem", "supplier", F.col("l_suppkey"), gone),
    ]
    return orphans(spark, tables, references)


def orphans_by_month(found: DataFrame) -> DataFrame:
    """(table_name, via, ref_month, reason, kind, n): counts per table and month, direct against inherited."""
    kind = F.when(F.col("level") == 1, "direct").otherwise("inherited")
    return found.groupBy("table_name", "via", "ref_month", "reason", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
