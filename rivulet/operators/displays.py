"""What a person is shown: rows made ready to print, without any printing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.bridges import potential_bridges
from rivulet.operators.gates import suggest_rules
from rivulet.operators.lookups import subject_display, unresolved

#: Width of a bar that shows a share.
BAR = 10


def bar(c: Column) -> Column:
    """A share from 0 to 1 as full and empty blocks; null counts as 0."""
    n = F.least(F.lit(BAR), F.greatest(F.lit(0), F.floor(F.coalesce(c, F.lit(0.0)) * BAR + 1e-9))).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(BAR) - n))


def confusions_shown(confusions: DataFrame) -> DataFrame:
    """(shown, reason) of every confusion."""
    return confusions.select(F.format_string("%s ≠ %s", "subject", "confused_with").alias("shown"), F.coalesce("reason", F.lit("")).alias("reason"))


def unresolved_shown(store: DataFrame, limit: int = 30) -> DataFrame:
    """(id, shown) of the first open facts; a subject that these name in several contexts has its context added."""
    rows = unresolved(store, limit)
    names = subject_display(rows)
    return rows.join(names, ["subject", "context"]).select("id", F.format_string("%s → %s(%s)", "display", "predicate", "object").alias("shown"))


def bridges_shown(bridges: DataFrame) -> DataFrame:
    """(id, shown, bridge_type, strength, bar, domains, reason, teaching_note) of bridges; a missing strength is 0.5."""
    strength = F.coalesce("strength", F.lit(0.5))
    none = lambda c, text="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(text))
    named = F.when((none("domain_a") == "") & (none("domain_b") == ""), "").otherwise(F.concat(none("domain_a", "?"), F.lit(" ↔ "), none("domain_b", "?")))
    return bridges.select(
        "id", F.concat_ws(" ↔ ", F.coalesce("term_a", F.lit("?")), F.coalesce("term_b", F.lit("?"))).alias("shown"), none("bridge_type", "?").alias("bridge_type"), strength.alias("strength"), bar(strength).alias("bar"),
        named.alias("domains"), none("reason", "no reason given").alias("reason"), none("teaching_note").alias("teaching_note"),
    )


def candidates_shown(store: DataFrame) -> DataFrame:
    """(shown, confidence, bar, suggested_type, reason) of the bridges that the store suggests."""
    why = F.when(F.col("strategy") == 1, "shared property").when(F.col("strategy") == 2, "stated by a fact").otherwise("same structural words")
    c = potential_bridges(store)
    return c.select(F.concat_ws(" ↔ ", "term_a", "term_b").alias("shown"), "confidence", bar(F.col("confidence")).alias("bar"), F.col("bridge_type").alias("suggested_type"), why.alias("reason"))


def learner_report(stats: DataFrame, min_samples: int = 5, threshold: float = 0.75) -> DataFrame:
    """(suggestion, link, inherited, rate, total) of every judged pair of predicates: the share of rejections of a block,
    else of approvals."""
    s = suggest_rules(stats, min_samples, threshold)
    share = F.when(F.col("suggestion") == "block", F.col("rejected")).otherwise(F.col("approved")) / F.col("total")
    return s.filter("total > 0").select("suggestion", "link", "inherited", F.round(share, 4).alias("rate"), "total")
