"""Parsers for questions, extractor and verifier replies, queue payloads, and the text chunker; native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet import vocabulary as V
from rivulet.functions.text import insert_norm

_BULLETS = "-*•–0123456789.) \t"


def question_terms(c: Column) -> Column:
    """Terms of a question: words of more than two characters that are no stop words, in lower case without '?' and 's."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: F.length(w) > 2)
    words = F.filter(words, lambda w: ~F.replace(F.lower(w), F.lit("?"), F.lit("")).isin(V.STOP_WORDS))
    return F.transform(words, lambda w: F.replace(F.replace(F.lower(w), F.lit("?"), F.lit("")), F.lit("'s"), F.lit("")))


def pipe_triples(df: DataFrame, id_col: str, text_col: str, default_truth: str = "T") -> DataFrame:
    """(id, line_no, subject, predicate, object, truth_value) of every line ``s | p | o [| T]``.

    Bullets and numbers before a line are stripped; a line needs three
    non-empty parts; a fourth part that begins with T, F or M is the truth.
    """
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
    parts = F.transform(F.split(F.ltrim(F.col("line"), F.lit(_BULLETS)), r"\|"), lambda x: F.trim(x))
    p = lines.select("id", "line_no", parts.alias("p")).filter((F.size("p") >= 3) & F.forall(F.slice("p", 1, 3), lambda x: F.length(x) > 0))
    letter = F.upper(F.left(F.coalesce(F.get("p", F.lit(3)), F.lit("")), F.lit(1)))
    truth = F.when(letter.isin("T", "F", "M"), letter).otherwise(default_truth)
    return p.select("id", "line_no", insert_norm(F.get("p", F.lit(0))).alias("subject"), insert_norm(F.get("p", F.lit(1))).alias("predicate"), insert_norm(F.get("p", F.lit(2))).alias("object"), truth.alias("truth_value"))


def verdict(c: Column) -> tuple[Column, Column]:
    """(verdict, reason) of a verifier reply: first letter T, F or M after VERDICT:, else M; the text after REASON:."""
    v = F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)VERDICT\s*:[\s*_`]*([TFM])", 1))
    return F.when(v == "", "M").otherwise(v), F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)REASON\s*:[ *_`]*([^\n]*)", 1))


def sections(c: Column) -> Column:
    """struct(reasoning, facts, confused) of a reply with REASONING / FACTS / CONFUSED headings; missing ones are ''."""
    part = lambda name: F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?is)(?:^|\n)[ *#]*{name}\s*:[ *]*(.*?)(?=\n[ *#]*(?:REASONING|FACTS|CONFUSED)\s*:|\z)", 1), F.lit(" \n\t"))
    return F.struct(part("REASONING").alias("reasoning"), part("FACTS").alias("facts"), part("CONFUSED").alias("confused"))


def payload(c: Column, key: str = "text") -> Column:
    """The string under ``key`` of a JSON object, or the whole text where it is none."""
    return F.coalesce(F.get_json_object(c, f"$.{key}"), c)


def bridge_verdict(c: Column) -> Column:
    """struct(meaningful, type, strength, reason, teaching) of a bridge verifier's reply."""
    line = lambda name: F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i)(?:^|\n)[ *]*{name}\s*:[ *]*([^\n]*)", 1))
    kind = F.lower(line("TYPE"))
    return F.struct(
        F.upper(line("MEANINGFUL")).startswith("Y").alias("meaningful"),
        F.when(kind.isin(V.BRIDGE_TYPES), kind).otherwise("emergent").alias("bridge_type"),
        F.least(F.lit(1.0), F.coalesce(F.regexp_extract(line("STRENGTH"), r"([0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(0.5))).alias("strength"),
        line("REASON").alias("reason"),
        line("TEACHING").alias("teaching_note"),
    )


def chunk_text(c: Column, chunk_size: int = 1500, overlap: int = 200) -> Column:
    """Chunks of a text: paragraphs packed greedily, the last ``overlap`` characters kept when a chunk is flushed.

    A paragraph is never split.  Null and blank texts have no chunks.
    """
    paras = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p, F.lit(" \n\t\r"))), lambda p: F.length(p) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    edges = F.lit(" \n\t\r")

    def pack(state: Column, p: Column) -> Column:
        cur = state["cur"]  # every packed paragraph is followed by a blank line, which counts
        full = (F.length(cur) + F.length(p) > chunk_size) & (F.length(cur) > 0)
        kept = F.when(F.length(cur) > overlap, F.right(cur, F.lit(overlap))).otherwise("")
        return F.struct(
            F.when(full, F.array_append(state["done"], F.trim(cur, edges))).otherwise(state["done"]).alias("done"),
            F.concat(F.when(full, kept).otherwise(cur), p, F.lit("\n\n")).alias("cur"),
        )

    return F.aggregate(paras, start, pack, lambda s: F.when(F.length(F.trim(s["cur"], edges)) > 0, F.array_append(s["done"], F.trim(s["cur"], edges))).otherwise(s["done"]))
