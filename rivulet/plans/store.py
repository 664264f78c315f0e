"""The fact store: entries as an immutable DataFrame, changed by functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import insert_norm, present
from rivulet.tables import Work

QUAD = ["subject", "context", "predicate", "object"]


def normalised(entries: DataFrame) -> DataFrame:
    """Entries as the store holds them: insert rule on the three terms, defaults for context ('general'), truth
    ('M'), quantifier ('universal') and source ('unknown'); rows with an empty term are rejected.  Context is
    not normalised."""
    e = entries.select(
        "id",
        insert_norm("subject").alias("subject"),
        F.coalesce("context", F.lit("general")).alias("context"),
        insert_norm("predicate").alias("predicate"),
        insert_norm("object").alias("object"),
        F.coalesce("quantifier", F.lit("universal")).alias("quantifier"),
        F.coalesce("truth_value", F.lit("M")).alias("truth_value"),
        F.coalesce("evidence_for", F.array().cast("array<string>")).alias("evidence_for"),
        F.coalesce("evidence_against", F.array().cast("array<string>")).alias("evidence_against"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("generation", F.lit(0)).alias("generation"),
        F.coalesce("grade_level", F.lit(0)).alias("grade_level"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.coalesce("needs_verification", F.lit(False)).alias("needs_verification"),
    )
    return e.filter(present("subject") & present("predicate") & present("object"))


def first_of(df: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The row with the least ``order`` of each key; ``order`` must be unique within a key.

    An aggregate, not a window: it combines on the map side, so a key with a
    third of all rows costs no more than its share.  One expression a column,
    so Catalyst drops the columns that a query does not read.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest]).select(*df.columns)


def facts(entries: DataFrame) -> DataFrame:
    """Normalised entries, each quad once (lowest id).  Null ids count as any other."""
    return first_of(normalised(entries), QUAD)


def judged(entries: DataFrame) -> DataFrame:
    """(id, subject, context, predicate, object, truth_value) of ``facts`` for those who only ask what is true: the truth is
    'T' or null.  One flag instead of texts, so the aggregate needs no sort."""
    n = normalised(entries)
    first = n.groupBy(*QUAD).agg(F.min("id").alias("id"), F.min_by(F.col("truth_value") == "T", "id").alias("t"))
    return first.select("id", *QUAD, F.when(F.col("t"), "T").alias("truth_value"))


def sourced(entries: DataFrame, most: int = 64) -> DataFrame:
    """``judged`` with the source.  Up to ``most`` sources are numbers on the way, so the aggregate needs no sort; texts
    beyond."""
    said = entries.select(F.coalesce("source", F.lit("unknown")).alias("source")).distinct()
    names = sorted(r[0] for r in said.limit(most + 1).collect())
    if not 0 < len(names) <= most:
        return facts(entries).select("id", *QUAD, F.when(F.col("truth_value") == "T", "T").alias("truth_value"), "source")
    listed = F.array(*[F.lit(x) for x in names])
    code = F.array_position(listed, F.col("source")).cast("int") * 2 + (F.col("truth_value") == "T").cast("int")
    first = normalised(entries).groupBy(*QUAD).agg(F.min("id").alias("id"), F.min_by(code, "id").alias("k"))
    return first.select("id", *QUAD, F.when(F.col("k") % 2 == 1, "T").alias("truth_value"), F.element_at(listed, F.shiftright("k", 1)).alias("source"))


def true_facts(store: DataFrame) -> DataFrame:
    return store.filter("truth_value = 'T'")


def append(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` that the store accepts: normalised, non-empty, quad not in the store, first of its quad.

    They keep the batch's id as ``input_id``; ``number`` gives new ids from
    this.  Nothing is inserted twice: a second append of the same batch returns
    no rows.
    """
    new = first_of(normalised(batch), QUAD)
    return new.join(store.select(*QUAD), QUAD, "left_anti").withColumnRenamed("id", "input_id")


def number(df: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """Dense ids from ``start`` in the given order without a single-partition window: range partitions, counted once."""
    work = Work(df.sparkSession, "number")
    local = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    local = work.put(local.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1)))
    counts = {r["_p"]: r["n"] for r in local.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    at, offsets = start, []
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    if not offsets:
        return local.drop("_m", "_p", "_i").withColumn(name, F.lit(None).cast("bigint"))
    starts = F.map_from_arrays(F.array(*[F.lit(p).cast("bigint") for p, _ in offsets]), F.array(*[F.lit(o).cast("bigint") for _, o in offsets]))
    return local.withColumn(name, F.element_at(starts, F.col("_p").cast("bigint")) + F.col("_i")).drop("_m", "_p", "_i")


def next_generation(store: DataFrame) -> int:
    return (store.agg(F.max("generation")).first()[0] or 0) + 1


def upsert_concepts(concepts: DataFrame, changes: DataFrame) -> DataFrame:
    """(subject, context, definition, source): last change wins per (subject, context); ``seq`` orders the changes."""
    both = concepts.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(changes)
    last = both.groupBy("subject", "context").agg(F.max_by(F.struct("definition", "source"), "seq").alias("b"))
    return last.select("subject", "context", "b.definition", "b.source")


def update_truth(store: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set truth, mark verified and append evidence for the ids in ``verdicts`` (id, truth, evidence; one row an id).
    Evidence for F goes to ``evidence_against``, any other to ``evidence_for``."""
    v = verdicts.select("id", F.col("truth").alias("_t"), F.col("evidence").alias("_e"))
    j = store.join(v, "id", "left")
    hit = F.col("_t").isNotNull()
    add = lambda c, when: F.when(hit & when & F.col("_e").isNotNull(), F.array_append(c, F.col("_e"))).otherwise(F.col(c))
    j = j.withColumns({
        "evidence_for": add("evidence_for", F.col("_t") != "F"),
        "evidence_against": add("evidence_against", F.col("_t") == "F"),
        "truth_value": F.coalesce("_t", "truth_value"),
        "verified": F.col("verified") | hit,
        "needs_verification": F.col("needs_verification") & ~hit,
    })
    return j.drop("_t", "_e").select(*store.columns)


def verify_offline(store: DataFrame, batch_size: int, safe: list[str]) -> DataFrame:
    """The first ``batch_size`` facts by id that need verification: a safe predicate makes them true and verified,
    any other only clears the flag.  Returns (id, predicate, truth_value, verified, needs_verification)."""
    batch = store.filter("needs_verification").orderBy("id").limit(batch_size)
    ok = F.col("predicate").isin(safe)
    return batch.select("id", "predicate", F.when(ok, "T").otherwise(F.col("truth_value")).alias("truth_value"), (F.col("verified") | ok).alias("verified"), F.lit(False).alias("needs_verification"))
