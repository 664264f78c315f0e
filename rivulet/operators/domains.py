"""Domains of terms, compatibility, and the filters that keep implausible facts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import vocabulary as V
from rivulet.functions.text import is_atomic
from rivulet.operators.derived import rows
from rivulet.plans.store import first_of
from rivulet.tables import Work, hot_of, skew_join


def classify(terms: DataFrame, domains: V.Domains | None = None, learned: DataFrame | None = None) -> DataFrame:
    """(term, domains): sorted domain labels of each distinct term of the column ``term``; unknown terms have none.

    A term gets the domain of every exact match (baseline or keyword) and of
    every keyword that shares a '_'-joined word with it, provided all shared
    words have four letters or more, and the labels in ``learned`` (term,
    domain).  Null terms are left out.
    """
    domains = domains or V.Domains()
    spark = terms.sparkSession
    t = terms.filter("term is not null").select("term").distinct().withColumn("key", F.replace(F.lower("term"), F.lit(" "), F.lit("_")))
    exact = t.join(rows(spark, domains.exact_rows(), "key string, domain string"), "key").select("term", "domain")
    parts = [(k, d, w) for k, d in domains.keyword_rows() for w in sorted(set(k.split("_")))]
    shared = t.select("term", F.explode(F.array_distinct(F.split("key", "_"))).alias("word")).join(rows(spark, parts, "keyword string, domain string, word string"), "word")
    by_word = shared.groupBy("term", "keyword", "domain").agg(F.bool_and(F.length("word") >= 4).alias("ok")).filter("ok").select("term", "domain")
    found = exact.unionByName(by_word)
    if learned is not None:
        found = found.unionByName(learned.select("term", "domain").join(t.select("term"), "term", "left_semi"))
    labels = found.groupBy("term").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    return t.select("term").join(labels, "term", "left").select("term", F.coalesce("domains", F.array().cast("array<string>")).alias("domains"))


def learned_labels(store: DataFrame, entry_domains: DataFrame) -> DataFrame:
    """(term, domain): the labels that atomic subjects have from the domains of their facts (entry_id, domain)."""
    own = store.filter(is_atomic("subject")).select(F.col("id").alias("entry_id"), F.col("subject").alias("term"))
    return own.join(entry_domains.select("entry_id", "domain"), "entry_id").select("term", "domain").distinct()


def context_of(domains: Column) -> Column:
    """'general' without domains; the first label, 'everyday' only when it is alone."""
    rest = F.array_remove(domains, "everyday")
    return F.when(F.size(domains) == 0, "general").when(F.size(rest) == 0, "everyday").otherwise(F.array_min(rest))


def _matrix(domains: V.Domains) -> Column:
    m = [(f"{a}|{b}", s) for a, b, s in domains.matrix() if s > 0]
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in m]), F.array(*[F.lit(s) for _, s in m]))


def compatibility(a: Column, b: Column, domains: V.Domains | None = None) -> Column:
    """Directed score of two label arrays: 0.5 when either is empty, else the best over all pairs of labels."""
    table = _matrix(domains or V.Domains())
    best = F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.coalesce(F.element_at(table, F.concat_ws("|", x, y)), F.lit(0.0))))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.5).otherwise(F.coalesce(best, F.lit(0.0)))


def compatible(a: Column, b: Column, domains: V.Domains | None = None) -> Column:
    """Unknown terms are compatible with all; else a score of 0.7 or more."""
    return (F.size(a) == 0) | (F.size(b) == 0) | (compatibility(a, b, domains) >= 0.7)


def labelled(facts: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``facts`` with the labels (term, domains) of one of its columns; unknown terms have none.

    One term may hold a large share of the facts: its rows are spread.
    """
    known = labels.select(F.col("term").alias(column), F.col("domains").alias(name))
    joined = skew_join(facts, known, column, hot_of(facts, column), "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def with_domains(facts: DataFrame, domains: V.Domains | None = None, learned: DataFrame | None = None) -> DataFrame:
    """``facts`` with ``s_domains`` and ``o_domains``; distinct terms are classified once, with the labels ``learned``."""
    terms = facts.select(F.explode(F.array("subject", "object")).alias("term"))
    labels = Work(facts.sparkSession, "labels").put(classify(terms, domains, learned).filter(F.size("domains") > 0))  # unknown terms need no join partner
    return labelled(labelled(facts, "subject", labels, "s_domains"), "object", labels, "o_domains")


def nonsense(facts: DataFrame, domains: V.Domains | None = None) -> DataFrame:
    """``facts`` with ``reason``: the first rule that a fact breaks, else 'ok'.

    Rules in order: self-reference; empty; too short; subject or object domain
    not allowed for a typed predicate (unknown domains pass); a hard-blocked
    pair of domains; longer than 100 characters.
    """
    f = with_domains(facts, domains)
    typed = {p: so for p, so in V.TYPED_PREDICATES.items()}

    def wrong(side: int, labels: str) -> Column:
        out = F.lit(False)
        for p, so in typed.items():
            if "*" not in so[side]:
                out = out | ((F.col("predicate") == p) & ~F.arrays_overlap(F.col(labels), F.array(*[F.lit(x) for x in so[side]])))
        return (F.size(labels) > 0) & out

    pairs = F.flatten(F.transform("s_domains", lambda x: F.transform(F.col("o_domains"), lambda y: F.concat_ws("|", F.least(x, y), F.greatest(x, y)))))
    blocked = F.arrays_overlap(pairs, F.array(*[F.lit("|".join(sorted(p))) for p in V.HARD_BLOCKS]))
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    reason = (
        F.when(F.col("subject").eqNullSafe(F.col("object")), "self-referential")
        .when((size("subject") == 0) | (size("predicate") == 0) | (size("object") == 0), "empty field")
        .when((size("subject") < 2) | (size("object") < 2), "term too short")
        .when(wrong(0, "s_domains"), "subject domain")
        .when(wrong(1, "o_domains"), "object domain")
        .when(blocked, "hard block")
        .when((size("subject") > 100) | (size("object") > 100), "term too long")
        .otherwise("ok")
    )
    return f.withColumn("reason", reason)


def predicate_profile(store: DataFrame, domains: V.Domains | None = None) -> DataFrame:
    """(predicate, domain, n): true facts with an atomic subject, once for each domain of the subject."""
    t = with_domains(store.filter((F.col("truth_value") == "T") & is_atomic("subject")), domains)
    return t.select("predicate", F.explode("s_domains").alias("domain")).groupBy("predicate", "domain").agg(F.count(F.lit(1)).alias("n"))


def type_gate(candidates: DataFrame, profile: DataFrame, domains: V.Domains | None = None, strict: bool = False) -> DataFrame:
    """``candidates`` with ``score``, ``confidence`` and ``gate`` ('allow', 'verify', 'block') for transitive conclusions.

    Score 0 blocks; a predicate profiled 50 times or more, never in a domain of
    the subject, blocks with 0.1; a score below 0.5 asks for verification.
    ``strict`` is kept for callers that also block what a literal gate lets pass.
    """
    f = with_domains(candidates, domains).withColumn("score", compatibility(F.col("s_domains"), F.col("o_domains"), domains))
    per = profile.groupBy("predicate").agg(F.sum("n").alias("_uses"), F.collect_set("domain").alias("_used"))  # at most one label a domain
    f = f.join(per, "predicate", "left")
    foreign = (F.coalesce("_uses", F.lit(0)) >= 50) & (F.size("s_domains") > 0) & ~F.arrays_overlap("s_domains", F.coalesce("_used", F.array().cast("array<string>")))
    gate = F.when(F.col("score") == 0, "block").when(foreign, "block").when(F.col("score") < (0.7 if strict else 0.5), "verify").otherwise("allow")
    conf = F.when(F.col("score") == 0, 0.0).when(foreign, 0.1).otherwise(F.col("score"))
    return f.withColumns({"gate": gate, "confidence": conf}).drop("_uses", "_used")


def analogy_gate(a: Column, b: Column, domains: V.Domains | None = None) -> Column:
    """Whether two label arrays may be called analogous: any score but 0."""
    return compatibility(a, b, domains) > 0


def cross_gate(a: Column, b: Column, o: Column, domains: V.Domains | None = None) -> Column:
    """Whether two subjects may share a property: none of the three scores is 0 and their mean is 0.3 or more."""
    s = [compatibility(a, b, domains), compatibility(a, o, domains), compatibility(b, o, domains)]
    return (s[0] > 0) & (s[1] > 0) & (s[2] > 0) & ((s[0] + s[1] + s[2]) / 3 >= 0.3 - 1e-12)


def gate(facts: DataFrame, source: str | None, profile: DataFrame, domains: V.Domains | None = None, skip: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected facts of one source; rejected ones carry ``reason``.

    Every fact passes the nonsense filter; 'transitive' ones the type gate,
    'analogy' ones the analogy gate between subject and object, 'cross_domain'
    ones with a subject of two members the cross-domain gate of both with the
    object.  ``skip`` lets everything pass (for seed data).
    """
    if skip:
        passed = facts.withColumn("reason", F.lit("ok"))
        return passed, passed.filter("false")
    f = nonsense(facts, domains)
    if source == "transitive":
        f = type_gate(f.drop("s_domains", "o_domains"), profile, domains)
        f = f.withColumn("reason", F.when((F.col("reason") == "ok") & (F.col("gate") == "block"), "type gate").otherwise(F.col("reason")))
        weak = F.col("confidence") < 0.5
        f = f.withColumns({"truth_value": F.when(weak, "M").otherwise(F.col("truth_value")), "needs_verification": weak | F.col("needs_verification")})
    elif source == "analogy":
        f = f.withColumn("reason", F.when((F.col("reason") == "ok") & ~analogy_gate(F.col("s_domains"), F.col("o_domains"), domains), "analogy gate").otherwise(F.col("reason")))
    elif source == "cross_domain":
        pair = F.split("subject", ",")
        f = f.withColumns({"_a": F.when(F.size(pair) == 2, F.get(pair, F.lit(0))), "_b": F.when(F.size(pair) == 2, F.get(pair, F.lit(1)))})
        labels = classify(f.select(F.explode(F.array("_a", "_b")).alias("term")), domains).filter(F.size("domains") > 0)
        for c in ("_a", "_b"):
            f = labelled(f, c, labels, f"{c}_domains")
        wrong = F.col("_a").isNotNull() & ~cross_gate(F.col("_a_domains"), F.col("_b_domains"), F.col("o_domains"), domains)
        f = f.withColumn("reason", F.when((F.col("reason") == "ok") & wrong, "cross gate").otherwise(F.col("reason"))).drop("_a", "_b", "_a_domains", "_b_domains")
    return f.filter("reason = 'ok'"), f.filter("reason <> 'ok'")


def scoped_insert(store: DataFrame, facts: DataFrame, source: str | None, profile: DataFrame, domains: V.Domains | None = None, skip: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): facts (with id) after ``gate`` whose triple, whatever its context, neither the store nor an
    earlier fact has; ``rejected`` has those that the gate refused, with ``reason``."""
    passed, rejected = gate(facts, source, profile, domains, skip)
    triple = ["subject", "predicate", "object"]
    first = first_of(passed.select(*facts.columns), triple)
    return first.join(store.select(*triple), triple, "left_anti").select(*facts.columns), rejected


def blocked_by_reason(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def analyze(store: DataFrame, domains: V.Domains | None = None) -> DataFrame:
    """(part, key, n): atomic subjects per domain, without and with several domains; derived facts of low, non-zero score."""
    subjects = classify(store.filter(is_atomic("subject")).select(F.col("subject").alias("term")), domains)
    per = subjects.select(F.explode("domains").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("domain").alias("part"), "key", "n")
    kinds = F.when(F.size("domains") == 0, "unclassified").when(F.size("domains") > 1, "several").otherwise("one")
    kind = subjects.groupBy(kinds.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("part"), "key", "n")
    derived = with_domains(store.filter(F.col("source").startswith("idea:")), domains)
    score = compatibility(F.col("s_domains"), F.col("o_domains"), domains)
    odd = derived.filter((score > 0) & (score < 0.3)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("suspicious").alias("part"), F.lit("").alias("key"), "n")
    return per.unionByName(kind).unionByName(odd)


def clean(store: DataFrame, domains: V.Domains | None = None) -> DataFrame:
    """``store`` without the facts that fail the nonsense filter."""
    return nonsense(store, domains).filter("reason = 'ok'").select(*store.columns)


def dictionary(spark: SparkSession, domains: V.Domains | None = None) -> DataFrame:
    """(a, b, score) of every directed pair of domains."""
    return rows(spark, (domains or V.Domains()).matrix(), "a string, b string, score double").withColumn("score", F.col("score").cast("double"))
