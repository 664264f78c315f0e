"""Lookups over facts: equality, substring, neighbours of a term, ambiguity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import is_atomic


def _key(term: str) -> str:
    """Lookup rule for a Python value."""
    return term.lower().replace(" ", "_")


def find(store: DataFrame, **values) -> DataFrame:
    """Rows equal in every given column; all rows when none is given."""
    return store.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in values.items()], F.lit(True)))


def concept(concepts: DataFrame, subject: str, context: str | None = None) -> DataFrame:
    """(context, definition) of a subject, in one context or in all."""
    found = concepts.filter(F.col("subject") == subject)
    return (found if context is None else found.filter(F.col("context") == context)).select("context", "definition")


def all_entries(store: DataFrame, truth_value: str | None = None) -> DataFrame:
    return store if truth_value is None else store.filter(F.col("truth_value") == truth_value)


def _holds(term: str) -> Column:
    # '_' in the term stands for any one character, as in LIKE
    return F.col("subject").ilike(f"%{_key(term)}%") | F.col("object").ilike(f"%{_key(term)}%")


def search(store: DataFrame, term: str) -> DataFrame:
    """Facts whose subject or object contains the term; order by truth_value, generation, id when collecting."""
    return store.filter(_holds(term))


def search_multi(store: DataFrame, terms: list[str]) -> DataFrame:
    """Facts that contain any of the terms, each once."""
    return store.filter(reduce(lambda a, b: a | b, [_holds(t) for t in terms], F.lit(False)))


def _in_context(context: str | None) -> Column:
    return F.lit(True) if context is None else F.col("context").isin(context, "general")


def about(store: DataFrame, subject: str, context: str | None = None) -> DataFrame:
    """True outgoing facts with an atomic object; context is the given one or 'general'."""
    return store.filter((F.col("subject") == _key(subject)) & (F.col("truth_value") == "T") & is_atomic("object") & _in_context(context))


def reverse(store: DataFrame, obj: str, context: str | None = None) -> DataFrame:
    """True incoming facts with an atomic subject."""
    return store.filter((F.col("object") == _key(obj)) & (F.col("truth_value") == "T") & is_atomic("subject") & _in_context(context))


def unresolved(store: DataFrame, limit: int = 30) -> DataFrame:
    """The first facts by id that are neither true nor false."""
    return store.filter("truth_value = 'M'").orderBy("id").limit(limit)


def known_subjects(store: DataFrame) -> DataFrame:
    return store.filter((F.col("truth_value") == "T") & is_atomic("subject")).select("subject").distinct()


def ambiguous_subjects(store: DataFrame) -> DataFrame:
    """(subject, n_contexts) of subjects in more than one non-empty context."""
    n = store.filter("context <> ''").select("subject", "context").distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("n_contexts"))
    return n.filter("n_contexts > 1")


def subject_display(store: DataFrame) -> DataFrame:
    """(subject, context, display): 'subject (context)' for ambiguous subjects, else the subject."""
    pairs = store.select("subject", "context").distinct()
    many = ambiguous_subjects(store).select("subject", F.lit(True).alias("many"))
    shown = F.when(F.col("many"), F.format_string("%s (%s)", "subject", "context")).otherwise(F.col("subject"))
    return pairs.join(many, "subject", "left").select("subject", "context", shown.alias("display"))


def raw_lookup(store: DataFrame, bridges: DataFrame, term: str, similar: int = 15) -> DataFrame:
    """(section, subject, context, predicate, object) of a term: what it says, what points to it, its bridges; when
    the first two are empty, the first subjects like it."""
    key = _key(term)
    cols = ["subject", "context", "predicate", "object"]
    out = about(store, key).select(F.lit("about").alias("section"), *cols)
    into = reverse(store, key).select(F.lit("reverse").alias("section"), *cols)
    b = bridges.filter((F.col("term_a") == key) | (F.col("term_b") == key))
    b = b.select(F.lit("bridge").alias("section"), F.col("term_a").alias("subject"), F.coalesce("domain_a", F.lit("")).alias("context"), F.col("bridge_type").alias("predicate"), F.col("term_b").alias("object"))
    found = out.unionByName(into)
    if found.isEmpty():
        like = search(store, key).filter(is_atomic("subject")).select("subject").distinct().orderBy("subject").limit(similar)
        found = like.select(F.lit("similar").alias("section"), "subject", F.lit("").alias("context"), F.lit("").alias("predicate"), F.lit("").alias("object"))
    return found.unionByName(b)
