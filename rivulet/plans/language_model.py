"""What the engine asks of a language model, with an offline default; replies are parsed by native expressions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.parsing import pipe_triples, sections, verdict


class LanguageModel(Protocol):
    """Any picklable object with ``ask``; '' means no answer."""

    def ask(self, prompt: str) -> str: ...


class Offline:
    """No model: every answer is empty, and callers take their deterministic way."""

    def ask(self, prompt: str) -> str:
        return ""


PROMPTS = {
    "verify": "Is this statement true? Answer with VERDICT: T, F or M and REASON: in one line.\n{0}",
    "facts": "List what you know about the topic, one 'subject | predicate | object | T' a line.\n{0}",
    "question": "Answer in three parts headed REASONING:, FACTS: and CONFUSED:, facts one 'subject | predicate | object' a line.\n{0}",
    "decompose": "Turn the text into lines 'subject | predicate | object'.\n{0}",
    "terms": "Give a JSON object with the fields 'subjects' and 'keywords' (lists of terms) for the question.\n{0}",
    "answer": "Answer the question from the facts below only, with their numbers in brackets.\n{0}",
}


def replies(df: DataFrame, id_col: str, text_col: str, kind: str, model: LanguageModel | None = None) -> DataFrame:
    """(id, reply) of asking ``PROMPTS[kind]`` for every row; a null text is asked nothing and gets ''."""
    prompt, model = PROMPTS[kind], model or Offline()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "reply": [model.ask(prompt.replace("{0}", t)) if isinstance(t, str) else "" for t in pdf["text"]]})

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "id bigint, reply string")


def verify(facts: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(id, truth, evidence) of the facts that the model judged; facts without an answer are left out."""
    text = facts.select("id", F.concat_ws(" ", "subject", "predicate", "object").alias("text"))
    r = replies(text, "id", "text", "verify", model).filter("reply <> ''")
    v, why = verdict(F.col("reply"))
    return r.select("id", v.alias("truth"), why.alias("evidence"))


def outcomes(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(link, inherited, approved) of judged transitive conclusions, for learning rules; M teaches nothing."""
    from rivulet.operators.gates import parse_chain_evidence

    chain = F.get("evidence_for", F.lit(0))
    link, inherited = parse_chain_evidence(chain)
    f = facts.filter("source = 'idea:transitive'").select("id", link.alias("link"), inherited.alias("inherited")).filter("link <> ''")
    return f.join(verdicts.filter("truth <> 'M'"), "id").select("link", "inherited", (F.col("truth") == "T").alias("approved"))


def extract_facts(texts: DataFrame, id_col: str, text_col: str, kind: str = "decompose", model: LanguageModel | None = None) -> DataFrame:
    """(id, line_no, subject, predicate, object, truth_value) from the model's replies for topics, questions or texts."""
    return facts_of(replies(texts, id_col, text_col, kind, model))


def facts_of(replies: DataFrame) -> DataFrame:
    """(id, line_no, subject, predicate, object, truth_value) of replies (id, reply): the part headed FACTS, or all of it."""
    body = F.when(F.contains("reply", F.lit("FACTS:")), sections(F.col("reply"))["facts"]).otherwise(F.col("reply"))
    return pipe_triples(replies.withColumn("reply", body), "id", "reply")


def confusions_of(replies: DataFrame) -> DataFrame:
    """(id, subject, confused_with, reason) of the lines 'a | b | reason' in the part headed CONFUSED."""
    lines = replies.select("id", F.posexplode(F.split(sections(F.col("reply"))["confused"], "\n")).alias("no", "line"))
    parts = lines.select("id", "no", F.transform(F.split(F.ltrim("line", F.lit("-•* ")), r"\|"), lambda x: F.trim(x)).alias("p")).filter((F.size("p") >= 2) & (F.length(F.get("p", F.lit(0))) > 0) & (F.length(F.get("p", F.lit(1))) > 0))
    return parts.select((F.col("id") * 1_000 + F.col("no")).alias("id"), F.get("p", F.lit(0)).alias("subject"), F.get("p", F.lit(1)).alias("confused_with"), F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("reason"))


def question_parse(c: Column) -> Column:
    """struct(subjects, keywords) of a reply to PROMPTS['terms']: a JSON object, with or without a code fence; null where
    it is none."""
    body = F.trim(F.regexp_replace(c, "```(?:json?)?", ""), F.lit(" \n\t\r"))
    return F.from_json(body, "subjects array<string>, keywords array<string>")
