"""Derived tables of the store: predicate map, duplicates, integrity, synonyms, domain clusters, closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import vocabulary as V
from rivulet.functions.text import is_atomic
from rivulet.operators.trees import closure, counts_within, pairs_within, within
from rivulet.plans.store import first_of
from rivulet.tables import union_all


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A literal table (a local relation, which Catalyst can fold and size)."""
    names = [c.split()[0] for c in schema.split(",")]
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    body = ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in values)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def predicate_lookup(variants: dict[str, list[str]] = V.PREDICATE_VARIANTS) -> list[tuple[str, str]]:
    """(original, canonical): canonical names map to themselves, a variant listed twice to the later name."""
    out = {}
    for name, others in variants.items():
        out[name] = name
        for o in others:
            out[o] = name
    return sorted(out.items())


def normalize_predicates(store: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """``store`` with canonical predicates; unknown ones stay.  ``lookup`` has original, canonical (one row an original)."""
    lookup = lookup if lookup is not None else rows(store.sparkSession, predicate_lookup(), "original string, canonical string")
    j = store.join(lookup, store.predicate == lookup.original, "left")
    return j.withColumn("predicate", F.coalesce("canonical", "predicate")).select(*store.columns)


def deduplicate(store: DataFrame, include_context: bool = False) -> DataFrame:
    """The lowest id of each (subject, predicate, object); other contexts count as duplicates unless included."""
    return first_of(store, ["subject", "predicate", "object"] + (["context"] if include_context else []))


def integrity(store: DataFrame, closure_table: DataFrame) -> DataFrame:
    """(check, n): self references, empty fields, long subjects, hierarchy children that are no subject."""
    one = store.agg(
        F.count_if(F.col("subject") == F.col("object")).alias("self_reference"),
        F.count_if((F.coalesce("subject", F.lit("")) == "") | (F.coalesce("predicate", F.lit("")) == "") | (F.coalesce("object", F.lit("")) == "")).alias("empty_field"),
        F.count_if(F.length("subject") > 80).alias("long_subject"),
    )
    lost = closure_table.select("child").distinct().join(store.select(F.col("subject").alias("child")), "child", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    checks = one.unpivot([], ["self_reference", "empty_field", "long_subject"], "check", "n")
    return checks.unionByName(lost.select(F.lit("lost_child").alias("check"), "n"))


def taxonomy_links(store: DataFrame) -> DataFrame:
    """Direct links (child, ancestor, depth) of the taxonomy predicates: true facts, atomic object, no self loops."""
    t = store.filter((F.col("truth_value") == "T") & F.col("predicate").isin(V.TAXONOMY_LINKS) & is_atomic("object") & (F.col("subject") != F.col("object")))
    return t.select(F.col("subject").alias("child"), F.col("object").alias("ancestor"), F.lit(1).alias("depth"))


def build_hierarchy(store: DataFrame, max_depth: int | None = 10) -> DataFrame:
    """(child, ancestor, depth): least depth of every pair, to ``max_depth`` (None: to any depth).

    Nodes may have several parents; a term on a ring comes out as its own
    ancestor.  Subjects may be compound.
    """
    if max_depth is None:
        return closure(taxonomy_links(store))
    return pairs_within(_up(store), max_depth)


def hierarchy_pairs(store: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """(c, a, depth), (id, term): ``build_hierarchy`` with numbers for terms, for counts that need no names."""
    return within(_up(store), max_depth)


def _up(store: DataFrame) -> DataFrame:
    return taxonomy_links(store).select("child", F.col("ancestor").alias("parent")).distinct()


def descendants(store: DataFrame, max_depth: int = 10) -> DataFrame:
    """(ancestor, h): how many terms ``build_hierarchy`` has below each."""
    return counts_within(_up(store), max_depth)


def build_synonyms(store: DataFrame) -> DataFrame:
    """(term, synonym, source, weight): parent to child 0.8, whole to part 0.6, manual 0.7; the first of these wins."""
    spark = store.sparkSession
    t = store.filter((F.col("truth_value") == "T") & is_atomic("subject") & is_atomic("object"))
    up = t.filter(F.col("predicate").isin("is_a", "subclass_of")).select(F.col("object").alias("term"), F.col("subject").alias("synonym"), F.lit("is_a").alias("source"), F.lit(0.8).alias("weight"), F.lit(1).alias("o"))
    part = t.filter(F.col("predicate").isin("has_part", "has_component", "contains")).select(F.col("subject").alias("term"), F.col("object").alias("synonym"), F.lit("has_part").alias("source"), F.lit(0.6).alias("weight"), F.lit(2).alias("o"))
    manual = rows(spark, [(t, s) for t, ss in V.MANUAL_SYNONYMS.items() for s in ss], "term string, synonym string").select("term", "synonym", F.lit("manual").alias("source"), F.lit(0.7).alias("weight"), F.lit(3).alias("o"))
    best = union_all([up, part, manual]).groupBy("term", "synonym").agg(F.min_by(F.struct("source", "weight"), "o").alias("b"))
    return best.select("term", "synonym", "b.source", "b.weight")


def word_grams(c: str, longest: int) -> Column:
    """All runs of 1 to ``longest`` words of a term, joined by '_', each once."""
    words = F.split(F.col(c), "_")

    def runs(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: i + (n - 1) <= F.size(words))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), "_"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, longest + 1)]))


def domain_clusters(store: DataFrame, keywords: dict[str, list[str]] = V.CLUSTER_KEYWORDS, literal_like: bool = False) -> DataFrame:
    """(entry_id, domain, confidence): a fact's own context with 1.0; facts of no specific context by the keywords of
    their subject and object, also with 1.0, several domains possible.

    A keyword matches whole words of a term; ``literal_like`` instead lets the
    joining '_' stand for any character, as LIKE does.
    """
    t = store.filter("truth_value = 'T'")
    general = F.coalesce("context", F.lit("")).isin("", "general", "cross_domain")
    own = t.filter(~general).select(F.col("id").alias("entry_id"), F.col("context").alias("domain"), F.lit(1.0).alias("confidence"))
    pairs = [(d, k) for d, ks in keywords.items() for k in ks]
    if not literal_like:
        table = rows(store.sparkSession, pairs, "domain string, word string")
        longest = max(k.count("_") + 1 for _, k in pairs)
        grams = F.array_union(word_grams("subject", longest), word_grams("object", longest))
        words = t.filter(general).select("id", F.explode(grams).alias("word"))
        hit = words.join(table, "word")
    else:
        like = lambda c, k: (F.col(c) == k) | F.col(c).like(f"{k}_%") | F.col(c).like(f"%_{k}") | F.col(c).like(f"%_{k}_%")
        found = F.array_compact(F.array(*[F.when(like("subject", k) | like("object", k), F.lit(d)) for d, k in pairs]))
        hit = t.filter(general).select("id", F.explode(found).alias("domain"))
    by_word = hit.select(F.col("id").alias("entry_id"), "domain", F.lit(1.0).alias("confidence")).distinct()
    return own.unionByName(by_word)
