"""Teaching by grades: facts and questions of each grade are added, pulses run, open facts are verified, a report is kept."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet import vocabulary as V
from rivulet.operators import journal
from rivulet.plans import language_model, pulse, store
from rivulet.plans.ingestion import as_entries
from rivulet.tables import Work


@dataclass
class Grade:
    """One grade: its number, topics and questions (the caller's data)."""

    number: int
    name: str
    topics: list[str] = field(default_factory=list)
    questions: list[str] = field(default_factory=list)


def _learn(current: DataFrame, texts: list[str], kind: str, grade: Grade, model) -> tuple[DataFrame, DataFrame | None]:
    """(store, confusions): the store with the facts that the model gives for topics or questions, and the confusions
    (id, subject, confused_with, reason, grade) of its replies; without a model the store is unchanged."""
    if model is None or not texts:
        return current, None
    spark, work = current.sparkSession, Work(current.sparkSession, "learn")
    asked = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    replies = work.put(language_model.replies(asked, "id", "text", kind, model))
    named = language_model.facts_of(replies).join(asked, "id").withColumn("context", F.lit("general"))
    if kind == "facts":
        named = named.withColumn("truth_value", F.lit("T"))
        source, evidence = F.lit(f"curriculum:grade_{grade.number}"), F.concat(F.lit(f"curriculum: {grade.name}, topic: "), "text")
    else:
        source, evidence = F.lit("llm:question"), F.concat(F.lit("Q&A: "), "text")
    named = named.withColumn("id", F.col("id") * 1_000_000 + F.col("line_no"))
    highest = current.agg(F.max("id"), F.max("generation")).first()
    new = store.append(current, as_entries(named, source, evidence, highest[1] or 0, grade.number))
    confused = language_model.confusions_of(replies).withColumn("grade", F.lit(grade.number))
    return current.unionByName(store.number(new, ["input_id"], (highest[0] or 0) + 1).select(*current.columns)), confused


def _judge(current: DataFrame, batch_size: int, model) -> DataFrame:
    """``current`` after one round of verification."""
    if model is not None:
        open_facts = current.filter("needs_verification").orderBy("id").limit(batch_size)
        return store.update_truth(current, language_model.verify(open_facts, model))
    judged = store.verify_offline(current, batch_size, V.SAFE_CURRICULUM)
    v = judged.filter("verified and truth_value = 'T'").select("id", F.lit("T").alias("truth"), F.lit("auto: safe chain").alias("evidence"))
    seen = judged.select("id", F.lit(True).alias("_seen"))
    return store.update_truth(current, v).join(seen, "id", "left").withColumn("needs_verification", F.col("needs_verification") & F.col("_seen").isNull()).drop("_seen")


def teach(current: DataFrame, bridges: DataFrame, grade: Grade, pulses: int = 5, after: int = 3, batch_sizes: tuple[int, int] = (10, 5), model=None, settings: pulse.Settings | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(store, confusions) after one grade: topics, up to ``pulses`` pulses, questions, up to ``after`` pulses, each run
    ending when a pulse finds nothing."""
    work = Work(current.sparkSession, "teach")
    confused = None
    for texts, kind, rounds, batch_size in ((grade.topics, "facts", pulses, batch_sizes[0]), (grade.questions, "question", after, batch_sizes[1])):
        learned, found = _learn(current, texts, kind, grade, model)
        current = work.put(learned)
        if kind == "question" and found is not None:
            confused = work.put(found)
        for _ in range(rounds):
            current, new = pulse.pulse(current, bridges, settings)
            current = work.put(_judge(work.put(current), batch_size, model))
            if new == 0:
                break
    return current, confused


def run(current: DataFrame, bridges: DataFrame, grades: list[Grade], **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(store, report, confusions) after all grades; the report has (grade, name, n_facts, n_true), a confusion comes out
    once, with its first grade."""
    spark = current.sparkSession
    rows, confusions = [], spark.createDataFrame([], "id long, subject string, confused_with string, reason string, grade int")
    for g in grades:
        current, confused = teach(current, bridges, g, **options)
        if confused is not None:
            confusions = confusions.unionByName(journal.add_confusions(confusions, confused))
        n = current.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth_value") == "T").alias("t")).first()
        rows.append((g.number, g.name, n["n"], n["t"]))
    return current, spark.createDataFrame(rows, "grade int, name string, n_facts long, n_true long"), confusions
