"""Texts to facts: chunks of books and articles, topics and tasks go to a language model, its lines become facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import vocabulary as V
from rivulet.functions.text import lookup_norm, present
from rivulet.operators.domains import classify, context_of
from rivulet.plans import language_model, store
from rivulet.sources import readers
from rivulet.tables import Work

def as_entries(facts: DataFrame, source: Column, evidence: Column, generation: int = 0, grade_level: int = 0) -> DataFrame:
    """Facts (id, subject, context, predicate, object, truth_value, ...) with all columns of an entry.  A fact of truth M
    needs verification."""
    none = F.array().cast("array<string>")
    return facts.select(
        "id", "subject", "context", "predicate", "object", F.lit("universal").alias("quantifier"), "truth_value", F.array(evidence).alias("evidence_for"), none.alias("evidence_against"),
        source.alias("source"), F.lit(generation).alias("generation"), F.lit(grade_level).alias("grade_level"), F.lit(False).alias("verified"), (F.col("truth_value") == "M").alias("needs_verification"),
    )


def _extracted(chunks: DataFrame, model, domains: V.Domains | None, kind: str, keep: list[str], truth: str | None) -> DataFrame:
    """Facts that the model finds in the rows of ``chunks`` (n, chunk, ...), with the context of their subject and the
    columns ``keep``; numbered by row and line."""
    work = Work(chunks.sparkSession, "ingestion")
    asked = work.put(chunks)
    found = work.put(language_model.extract_facts(asked, "n", "chunk", kind, model))
    found = found.filter(present("subject") & present("predicate") & present("object"))
    facts = readers.with_context(found, domains).join(asked.select(F.col("n").alias("id"), *keep), "id")
    facts = facts.withColumn("id", F.col("id") * 1_000_000 + F.col("line_no"))
    return facts if truth is None else facts.withColumn("truth_value", F.lit(truth))


def _numbered(chunks: DataFrame, order: list[str]) -> DataFrame:
    return store.number(chunks, order, 0, "n")


def textbook_facts(spark: SparkSession, path: str, model, grade_level: int = 0, domains: V.Domains | None = None) -> DataFrame:
    """Entries from the text files below a path: whole files in chunks, each fact with file and chunk as its evidence."""
    chunks = _numbered(readers.read_textbook(spark, path), ["id", "chunk_no"]).withColumnRenamed("id", "file")
    facts = _extracted(chunks, model, domains, "decompose", ["file", "chunk_no"], "T")
    return as_entries(facts, F.concat(F.lit("textbook:"), "file"), F.concat(F.lit("textbook: "), "file", F.lit(", chunk "), F.col("chunk_no") + 1), 0, grade_level)


def article_facts(texts: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", domains: V.Domains | None = None, **limits) -> DataFrame:
    """Entries from article extracts; ``limits`` are those of ``readers.extract_chunks``."""
    chunks = _numbered(readers.extract_chunks(texts, id_col, text_col, **limits), ["id", "title", "chunk_no"])
    return as_entries(_extracted(chunks, model, domains, "decompose", ["title"], "T"), F.lit("wikipedia"), F.concat(F.lit("wikipedia: "), "title"))


def section_facts(texts: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", domains: V.Domains | None = None, **limits) -> DataFrame:
    """Entries from the sections of plain article files; ``limits`` are those of ``readers.section_chunks``."""
    chunks = _numbered(readers.section_chunks(texts, id_col, text_col, **limits), ["id", "section", "chunk_no"])
    return as_entries(_extracted(chunks, model, domains, "decompose", [], "T"), F.lit("wikipedia"), F.lit("wikipedia"))


def topic_facts(spark: SparkSession, topics: list[str], model, domains: V.Domains | None = None) -> DataFrame:
    """Entries that the model gives for topics to start with; their context is that of the topic."""
    names = spark.createDataFrame([(i, t) for i, t in enumerate(topics)], "n long, chunk string").withColumn("term", lookup_norm("chunk"))
    labels = classify(names.select("term"), domains).select("term", context_of(F.col("domains")).alias("topic_context"))
    asked = names.join(labels, "term").drop("term")
    facts = _extracted(asked, model, domains, "facts", ["topic_context"], None)
    return as_entries(facts.withColumn("context", F.col("topic_context")), F.lit("llm:seed"), F.lit("LLM seed generation"))


def ingest(current: DataFrame, entries: DataFrame, source_type: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(store, log): the store with the entries that it did not hold, and a row of the ingest log (source_type, source,
    entries_read, facts_added, errors)."""
    work = Work(current.sparkSession, "ingest")
    entries = work.put(entries)
    top = current.agg(F.max("id")).first()[0] or 0
    new = work.put(store.number(store.append(current, entries), ["input_id"], top + 1).select(*current.columns))
    log = entries.agg(F.lit(source_type).alias("source_type"), F.lit(source).alias("source"), F.count(F.lit(1)).alias("entries_read"), F.lit(new.count()).cast("bigint").alias("facts_added"), F.lit(0).cast("bigint").alias("errors"))
    return current.unionByName(new), log
