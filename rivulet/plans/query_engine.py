"""Answering a question from the store: terms, hits, neighbours, bridges and a path, as one tagged DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import vocabulary as V
from rivulet.functions.text import is_atomic
from rivulet.operators.bridges import find_bridges
from rivulet.operators.domains import classify, context_of
from rivulet.operators.fulltext import search_index
from rivulet.operators.graph import find_path
from rivulet.operators.lookups import about, search_multi
from rivulet.plans import language_model
from rivulet.tables import Work, union_all

COLUMNS = ["subject", "context", "predicate", "object"]


def extract_terms(question: str) -> list[str]:
    """Terms of a question without a model: longer words that are no stop words."""
    words = [w for w in question.split() if len(w) > 2 and w.lower().replace("?", "") not in V.STOP_WORDS]
    return [w.lower().replace("?", "").replace("'s", "") for w in words]


def parse_terms(spark: SparkSession, question: str, model=None) -> list[str]:
    """Terms of a question: the subjects, then the keywords that the model names; without an answer the longer words."""
    asked = language_model.replies(spark.createDataFrame([(0, question)], "id long, text string"), "id", "text", "terms", model)
    p = asked.select(language_model.question_parse(F.col("reply")).alias("p"), "reply").first()
    if p["p"] is None and p["reply"]:  # an answer that is no JSON: its question's longer words
        return [w.lower().replace("?", "").replace("'s", "") for w in question.split() if len(w) > 3]
    named = [t for part in p["p"] or () for t in part or () if t]
    return list(dict.fromkeys(named)) or extract_terms(question)


def query_context(spark: SparkSession, terms: list[str], domains: V.Domains | None = None) -> str | None:
    """The context of the first term that has a specific one."""
    if not terms:
        return None
    t = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, term string")
    found = classify(t, domains).join(t, "term").select("i", context_of(F.col("domains")).alias("context")).filter("context <> 'general'").orderBy("i").first()
    return found["context"] if found else None


def synthesize(facts: DataFrame, question: str, model, most_facts: int = 40, most_bridges: int = 10) -> str:
    """The model's answer from the tagged facts of ``answer``; '' without facts or without a model.  The prompt holds the
    first facts by section and terms, which is what a prompt can hold."""
    line = F.concat(F.lit("["), "section", F.lit("] "), "subject", F.lit(" -> "), "predicate", F.lit("("), "object", F.lit(")"))
    order = F.when(F.col("section") == "path", 0).when(F.col("section") == "bridge", 2).otherwise(1)
    part = lambda kind, n: [r[0] for r in facts.filter(kind).orderBy(order, "section", *COLUMNS).select(line).limit(n).collect()]
    lines = part("section <> 'bridge'", most_facts) + part("section = 'bridge'", most_bridges)
    if not lines or model is None:
        return ""
    asked = facts.sparkSession.createDataFrame([(0, "\n".join([f"Question: {question}", *lines]))], "id long, text string")
    return language_model.replies(asked, "id", "text", "answer", model).first()["reply"]


def answer(store: DataFrame, bridges: DataFrame, question: str, index: DataFrame | None = None, context: str | None = None, seeds: int = 10, bridge_terms: int = 5, model=None) -> DataFrame:
    """(section, subject, context, predicate, object) for a question: hits, facts next to the first ``seeds`` hits,
    bridges of the terms, what the bridged terms say, and a path between the first two terms."""
    work = Work(store.sparkSession, "answer")
    terms = extract_terms(question) if model is None else parse_terms(store.sparkSession, question, model)
    if not terms:
        return store.filter("false").select(F.lit("hit").alias("section"), *COLUMNS)
    hits = work.put(search_index(store, index, terms) if index is not None else search_multi(store, terms))
    first = [r["subject"] for r in hits.filter(is_atomic("subject")).orderBy("truth_value", "generation", "id").limit(seeds).select("subject").collect()]
    near = store.filter((F.col("truth_value") == "T") & (F.col("subject").isin(first) | F.col("object").isin(first)))
    linked = union_all([find_bridges(bridges, t) for t in terms]).dropDuplicates(["id"])
    strongest = linked.orderBy(F.desc("strength"), "id").limit(bridge_terms).select("term_a", "term_b").collect()
    beyond = sorted({t for r in strongest for t in r if t and t not in terms})
    pick = lambda df, name: df.select(F.lit(name).alias("section"), *COLUMNS)
    parts = [pick(hits, "hit"), pick(near.join(hits.select("id"), "id", "left_anti"), "near")]
    parts.append(linked.select(F.lit("bridge").alias("section"), F.col("term_a").alias("subject"), F.coalesce("domain_a", F.lit("")).alias("context"), F.col("bridge_type").alias("predicate"), F.col("term_b").alias("object")))
    parts += [pick(about(store, t, context), "beyond") for t in beyond]
    if len(terms) > 1:
        path = find_path(store, terms[0], terms[1], context=context)
        parts.append(path.select(F.lit("path").alias("section"), F.lit(terms[0]).alias("subject"), F.lit("").alias("context"), F.col("path").alias("predicate"), F.lit(terms[1]).alias("object")))
    return union_all(parts).distinct()
