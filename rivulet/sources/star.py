"""Facts from the star-schema tables, as a source for any operator on (subject, context, predicate, object)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.text import insert_norm
from rivulet.tables import load, union_all


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (subject, context, predicate, object) over regions, nations, suppliers, customers, parts and line items."""
    region, nation, supplier, customer, part, lineitem = (load(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer", "part", "lineitem"))

    def fact(df: DataFrame, s, ctx: str, p: str, o) -> DataFrame:
        return df.select(insert_norm(F.col(s) if isinstance(s, str) else s).alias("subject"), F.lit(ctx).alias("context"), F.lit(p).alias("predicate"), insert_norm(o).alias("object"))

    part_name = lambda c: F.concat(F.lit("part_"), F.col(c).cast("string"))
    n_in_r = nation.join(region, nation.n_regionkey == region.r_regionkey)
    s_in_n = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    c_in_n = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    # pairs first: a supplier delivers a part many times
    made = lineitem.select("l_suppkey", "l_partkey").distinct().join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    frames = [
        fact(region, "r_name", "general", "is_a", F.lit("region")),
        fact(n_in_r, "n_name", "general", "located_in", F.col("r_name")),
        fact(nation, "n_name", "general", "is_a", F.lit("nation")),
        fact(s_in_n, "s_name", "economics", "located_in", F.col("n_name")),
        fact(supplier, "s_name", "economics", "is_a", F.lit("supplier")),
        fact(made, "s_name", "engineering", "produces", part_name("l_partkey")),
        fact(c_in_n, "c_name", "economics", "located_in", F.col("n_name")),
        fact(customer, "c_name", "economics", "related_to", F.col("c_mktsegment")),
        fact(part, part_name("p_partkey"), "engineering", "is_a", F.col("p_type")),
        fact(part, part_name("p_partkey"), "engineering", "created_by", F.col("p_brand")),
        fact(part, part_name("p_partkey"), "engineering", "has_property", F.concat(F.lit("size_"), F.col("p_size").cast("string"))),
    ]
    return union_all(frames).distinct()
