"""The inference pulse: merge, transitive, cross-domain and analogy rules, with ordered caps and the fix-point driver.

Each rule returns new facts (subject, context, predicate, object, truth_value,
needs_verification, source, evidence, rank) in the order in which they fire.
With a cap, only as much of the input is expanded as the first ``cap`` results
need: sources and groups are taken in growing blocks of their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivulet import vocabulary as V
from rivulet.functions.text import TERM_CHARS, is_atomic
from rivulet.operators.gates import Rules
from rivulet.plans.store import QUAD, number, verify_offline
from rivulet.tables import Work, free, hot_of, skew_join, union_all

CAP = 50
#: The first block of ordered input that a capped rule expands, and how much the next ones grow.
BLOCK, GROWTH = 256, 8


@dataclass
class Settings:
    """One configuration of the rules."""

    cap: int | None = CAP
    transitive_skip: tuple = tuple(V.TRANSITIVE_SKIP)
    cross_skip: tuple = tuple(V.CROSS_SKIP)
    analogy_skip: tuple = tuple(V.ANALOGY_SKIP)
    share: float = 0.5
    similarity: float = 0.6
    #: Variants: chains over any contexts; truth by the gate's confidence (below 0.5: M, else T); largest group of a
    #: shared property (None: by ``share``); least size of a profile and of what two profiles share.
    ignore_context: bool = False
    truth_by_confidence: bool = False
    group_max: int | None = None
    min_profile: int = 1
    min_shared: int = 1
    rules: Rules = None

    def __post_init__(self):
        self.rules = self.rules or Rules()


def _true(store: DataFrame) -> DataFrame:
    return store.filter("truth_value = 'T'").select("id", *QUAD)


def _new(found: DataFrame, store: DataFrame, order: list, cap: int | None) -> DataFrame:
    """Not in the store, first of each quad, the first ``cap`` in order."""
    rest = [c for c in found.columns if c not in QUAD]
    first = found.groupBy(*QUAD).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b")).select(*QUAD, *[F.col(f"b.{c}").alias(c) for c in rest])
    fresh = first.join(store.select(*QUAD), QUAD, "left_anti")
    return fresh if cap is None else fresh.orderBy(*order, *QUAD).limit(cap)


def merge(store: DataFrame, s: Settings) -> DataFrame:
    """Several objects of one subject, context and predicate as one compound object.

    The compound is cut to the length of a term when stored, so only the first
    objects in order can show in it; no more are gathered, however many a group
    has.
    """
    t = _true(store).filter(is_atomic("object"))
    key = ["subject", "context", "predicate"]
    # a store holds each quad once, so the rows of a group are its distinct objects
    groups = t.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1")
    near = t.join(groups, key).withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("object"))).filter(F.col("r") <= TERM_CHARS // 2)
    made = near.groupBy(*key, "n", "first").agg(F.array_join(F.array_sort(F.collect_list("object")), ",").alias("o"))  # at most 50 objects
    made = made.select(*key, F.rtrim(F.left("o", F.lit(TERM_CHARS)), F.lit("_")).alias("object"), F.concat(F.lit("merged "), F.col("n")).alias("evidence"), "first")
    out = _new(made, store, [F.col("first")], s.cap)
    return out.select(*QUAD, F.lit("T").alias("truth_value"), F.lit(False).alias("needs_verification"), F.lit("idea:merge").alias("source"), "evidence", F.col("first").alias("rank"))


def profile_sizes(store: DataFrame, least: int = 3) -> DataFrame:
    """(subject, predicate 'profile_size', object, evidence) of atomic subjects with ``least`` true facts or more: how
    many predicates and objects they have."""
    t = _true(store).filter(is_atomic("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("predicate").alias("p"), F.count_distinct("object").alias("o"))
    made = F.concat(F.lit("has_"), F.col("p"), F.lit("_predicates_and_"), F.col("o"), F.lit("_objects"))
    return t.filter(F.col("n") >= least).select("subject", F.lit("profile_size").alias("predicate"), made.alias("object"), F.concat(F.lit("merged "), F.col("n")).alias("evidence"))


def chains(left: DataFrame, right: DataFrame, s: Settings) -> DataFrame:
    """All chains of two facts whose contexts agree, with the gate's verdict."""
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in ["id", *QUAD]], F.col("object").alias("mid"))
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in ["id", *QUAD]], F.col("subject").alias("mid"))
    agree = F.lit(True) if s.ignore_context else (F.col("a_context") == F.col("b_context")) | (F.col("a_context") == "general") | (F.col("b_context") == "general")
    # a subject may hold a large share of the facts: its rows are spread, the few chains that lead to it are repeated
    j = skew_join(b, a, "mid", hot_of(b, "mid"), "inner", "b_id").filter(agree & (F.col("a_subject") != F.col("b_object"))).drop("mid")
    return j.withColumn("verdict", s.rules.verdict(F.col("a_predicate"), F.col("b_predicate")))


def _chain_input(store: DataFrame, s: Settings) -> DataFrame:
    return _true(store).filter(is_atomic("object") & ~F.col("predicate").isin(list(s.transitive_skip)))


def transitive(store: DataFrame, s: Settings) -> DataFrame:
    """Conclusions over two facts as M, to be verified; the first chain by (id, second context, second id) wins."""
    t = _chain_input(store, s)

    def conclude(left: DataFrame) -> DataFrame:
        c = chains(left, t, s).filter(F.startswith("verdict", F.lit("allow")))
        evidence = F.concat(F.lit("transitive["), "a_predicate", F.lit("→"), "b_predicate", F.lit("]: "), "a_subject", F.lit("("), "a_context", F.lit(")→"), "a_object", F.lit("→"), "b_object")
        return c.select(F.col("a_subject").alias("subject"), F.col("a_context").alias("context"), F.col("b_predicate").alias("predicate"), F.col("b_object").alias("object"), evidence.alias("evidence"), "a_id", "b_context", "b_id", s.rules.confidence(F.col("a_predicate"), F.col("b_predicate")).alias("conf"))

    order = [F.col("a_id"), F.col("b_context"), F.col("b_id")]
    if s.cap is None:
        out = _new(conclude(t), store, order, None)
    else:
        # the order begins with the first fact's id: a prefix of ids gives a prefix of the conclusions
        work = Work(store.sparkSession, "transitive")
        size = BLOCK
        total = t.count()
        while True:
            head = t.orderBy("id").limit(size)
            out = work.put(_new(conclude(head), store, order, s.cap))
            if size >= total or out.count() >= s.cap:
                break
            size *= GROWTH
    sure = (F.col("conf") >= 0.5) if s.truth_by_confidence else F.lit(False)
    return out.select(*QUAD, F.when(sure, "T").otherwise("M").alias("truth_value"), (~sure).alias("needs_verification"), F.lit("idea:transitive").alias("source"), "evidence", F.col("a_id").alias("rank"))


def blocked_chains(store: DataFrame, s: Settings) -> DataFrame:
    """(link, inherited, verdict, n) of the chains that the gate blocks.

    Counted without expanding chains: per mid term and context, the rows of
    either side are counted first, and the counts are multiplied.
    """
    t = _chain_input(store, s)
    a = t.groupBy(F.col("object").alias("mid"), F.col("context").alias("ca"), F.col("predicate").alias("link")).agg(F.count(F.lit(1)).alias("na"))
    b = t.groupBy(F.col("subject").alias("mid"), F.col("context").alias("cb"), F.col("predicate").alias("inherited")).agg(F.count(F.lit(1)).alias("nb"))
    agree = (F.col("ca") == F.col("cb")) | (F.col("ca") == "general") | (F.col("cb") == "general")
    j = a.join(b, "mid").filter(agree).withColumn("verdict", s.rules.verdict(F.col("link"), F.col("inherited"))).filter(F.startswith("verdict", F.lit("block")))
    every = j.groupBy("link", "inherited", "verdict").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
    # chains that lead back to their start are no conclusions: those are two facts with swapped ends
    x, y = t.alias("x"), t.alias("y")
    ctx = (F.col("x.context") == F.col("y.context")) | (F.col("x.context") == "general") | (F.col("y.context") == "general")
    back = x.join(y, (F.col("x.object") == F.col("y.subject")) & (F.col("x.subject") == F.col("y.object")) & ctx).groupBy(F.col("x.predicate").alias("link"), F.col("y.predicate").alias("inherited")).agg(F.count(F.lit(1)).alias("m"))
    return every.join(back, ["link", "inherited"], "left").select("link", "inherited", "verdict", (F.col("n") - F.coalesce("m", F.lit(0))).cast("bigint").alias("n")).filter("n > 0")


def _sharing(store: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Facts whose property may be shared, and the groups (predicate, object, n, first) of several that are not too general."""
    everyone = _true(store).filter(is_atomic("subject"))
    total = everyone.select("subject", "context").distinct().count()
    t = everyone.filter(is_atomic("object") & ~F.col("predicate").isin(list(s.cross_skip)))
    most = s.share * total if s.group_max is None else s.group_max
    return t, t.groupBy("predicate", "object").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter((F.col("n") > 1) & (F.col("n") <= most))


def shared_properties(store: DataFrame, s: Settings) -> DataFrame:
    """(predicate, object, n, first, n_links): all groups of subjects that share a property, with the number of links of
    each member; the members are the facts themselves."""
    return _sharing(store, s)[1].withColumn("n_links", F.col("n") - 1)


def cross_domain(store: DataFrame, bridges: DataFrame, s: Settings) -> DataFrame:
    """Pairs of subjects that share a predicate and an object, as a compound subject with 'both_' predicate.

    Groups with more than ``share`` of all atomic subjects are too general.  A
    pair linked by a bridge, or by an earlier pair of the same pulse, is
    'bridge-validated'; else the evidence is 'shared' and a bridge emerges.
    """
    if s.cap is None:
        raise ValueError("cross_domain needs a cap: the pairs of a group are not listed; use shared_properties")
    work = Work(store.sparkSession, "cross")
    t, groups = _sharing(store, s)
    key = ["predicate", "object"]
    groups = work.put(groups)
    n_groups = groups.count()

    def pairs(some: DataFrame, members: int) -> DataFrame:
        m = t.join(some, key).withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("subject", "context"))).filter(F.col("r") <= members)
        a = m.select(*key, "first", F.col("subject").alias("s1"), F.col("context").alias("c1"))
        b = m.select(*key, F.col("subject").alias("s2"), F.col("context").alias("c2"))
        j = a.join(b, key).filter((F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("c1") < F.col("c2"))))
        subject = F.rtrim(F.left(F.concat("s1", F.lit(","), "s2"), F.lit(TERM_CHARS)), F.lit("_"))
        ctx = F.when(F.col("c1") == F.col("c2"), F.col("c1")).otherwise("cross_domain")
        return j.select(subject.alias("subject"), ctx.alias("context"), F.concat(F.lit("both_"), "predicate").alias("predicate"), "object", "first", "s1", "c1", "s2", "c2")

    order = [F.col("first"), F.col("s1"), F.col("c1"), F.col("s2"), F.col("c2")]
    take, members = BLOCK // 4, s.cap + 1
    largest = groups.agg(F.max("n")).first()[0] or 0

    def whole(out: DataFrame) -> bool:
        """No pair of a member beyond the held ones comes before one of ``out``: the first such pair is that of the
        first member of the first group that is not held in full."""
        cut = groups.filter(F.col("n") > members).orderBy("first", *key).limit(1)
        lead = t.join(cut, key).groupBy("first").agg(F.min(F.struct("subject", "context")).alias("m")).first()
        if lead is None:
            return True
        same = (F.col("s1") == lead["m"]["subject"]) & (F.col("c1") == lead["m"]["context"])
        return out.filter((F.col("first") > lead["first"]) | ((F.col("first") == lead["first"]) & ~same)).isEmpty()

    while True:
        # in order of a group's pairs, its first cap + 1 members fill the cap unless pairs are known already
        out = work.put(_new(pairs(groups.orderBy("first", *key).limit(take), members), store, order, s.cap))
        full = out.count() >= s.cap
        if members >= largest and (full or take >= n_groups) or full and whole(out):
            break
        take, members = take if full else take * GROWTH, members * GROWTH
    linked = bridges.filter("term_a is not null and term_b is not null").select(F.least("term_a", "term_b").alias("x"), F.greatest("term_a", "term_b").alias("y")).distinct().withColumn("known", F.lit(True))
    out = out.withColumns({"x": F.least("s1", "s2"), "y": F.greatest("s1", "s2")}).join(linked, ["x", "y"], "left")
    nth = F.row_number().over(W.partitionBy("x", "y").orderBy(*order, "subject", "context", "predicate", "object"))
    evidence = F.when(F.coalesce("known", F.lit(False)) | (nth > 1), "bridge-validated").otherwise("shared")
    return out.select(*QUAD, F.lit("T").alias("truth_value"), F.lit(False).alias("needs_verification"), F.lit("idea:cross_domain").alias("source"), evidence.alias("evidence"), F.col("first").alias("rank"), "s1", "s2")


def emergent_bridges(pairs: DataFrame) -> DataFrame:
    """(term_a, term_b, bridge_type, strength, discovered_by) for the pairs that no bridge linked yet."""
    return pairs.filter("evidence = 'shared'").select(F.col("s1").alias("term_a"), F.col("s2").alias("term_b"), F.lit("emergent").alias("bridge_type"), F.lit(0.3).alias("strength"), F.lit("pulse").alias("discovered_by")).distinct()


def profiles(store: DataFrame, s: Settings) -> DataFrame:
    """(context, profile, n, first_subject): distinct predicate sets and how many subjects have each.

    Subjects with the same set are one row, so the comparison grows with the
    sets, not with the subjects.  A set has at most as many members as there
    are predicates.
    """
    return _classes(_profiled(store, s))


def _classes(members: DataFrame) -> DataFrame:
    return members.groupBy("context", "profile").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


def _profiled(store: DataFrame, s: Settings) -> DataFrame:
    t = _true(store).filter(is_atomic("subject") & ~F.col("predicate").isin(list(s.analogy_skip)))
    p = t.groupBy("subject", "context").agg(F.array_sort(F.collect_set("predicate")).alias("profile"))
    return p if s.min_profile <= 1 else p.filter(F.size("profile") >= s.min_profile)


def _encoded(classes: DataFrame, s: Settings) -> DataFrame:
    """(cls, context, profile, n, code, mark) of classes (cls, context, profile): ``code`` are the numbers of the predicates,
    rarest of the context first, ``mark`` a bit for each. Classes without another of a size that could be similar are
    left out."""
    work = Work(classes.sparkSession, "profiles")
    words = classes.select("cls", "context", F.explode("profile").alias("w"))
    rarity = words.groupBy("context", "w").agg(F.count(F.lit(1)).alias("df"))
    numbers = number(rarity, ["df", "w", "context"], 0, "code").select("context", "w", "code")
    codes = words.join(numbers, ["context", "w"]).groupBy("cls").agg(F.array_sort(F.collect_list("code")).alias("code"))
    sizes = classes.groupBy("context", F.size("profile").alias("n")).agg(F.count(F.lit(1)).alias("k"))
    x, y = sizes.alias("x"), sizes.alias("y")
    near = (F.least("x.n", "y.n") >= _needed(F.col("x.n"), F.col("y.n"), s)) & ((F.col("x.n") != F.col("y.n")) | (F.col("x.k") > 1))
    sizes = x.join(y, (F.col("x.context") == F.col("y.context")) & near).select("x.context", "x.n").distinct()
    e = classes.withColumn("n", F.size("profile")).join(sizes, ["context", "n"], "left_semi").join(codes, "cls")
    # one bit a predicate: bits that one side alone has are predicates that it alone has
    mark = F.aggregate(F.transform("code", lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(c, F.lit(64)).cast("int"))), F.lit(0).cast("bigint"), lambda m, bit: m.bitwiseOR(bit))
    return work.put(e.select("cls", "context", "profile", "n", "code", mark.alias("mark")))


def _needed(n1: Column, n2: Column, s: Settings) -> Column:
    """How many members two sets of these sizes must share."""
    return F.greatest((n1 + n2) * (s.similarity / (1 + s.similarity)) - 1e-9, F.lit(float(s.min_shared)))


#: Sets with the same rare predicate that one task compares with all others of it.
BESIDE = 1024


def _similar(encoded: DataFrame, s: Settings, some: DataFrame | None = None) -> DataFrame:
    """(context, a, p1, b, p2, sim): similar classes of ``_encoded``, each pair once; with ``some`` (cls) those pairs with a
    class of it, as ``a``, where pairs within it come in both directions.

    Candidates share one of the first predicates of both sets (prefix filter): two sets of that similarity must share one
    among their first size - ceil(similarity * size) + 1 members, so nothing is lost. A pair is met at each predicate that
    both prefixes hold and kept at the first, so candidates are never shuffled.
    """
    n = F.col("n")
    prefix = n - F.greatest(F.ceil(F.lit(s.similarity) * n - 1e-9), F.lit(s.min_shared)).cast("int") + 1
    head = encoded.filter(n >= s.min_shared).select("cls", "context", "profile", "n", "code", "mark", F.posexplode(F.slice("code", F.lit(1), prefix)).alias("i", "w")).withColumn("left", F.col("n") - F.col("i")).drop("i")
    crowd = head.groupBy("w").agg((F.count(F.lit(1)) / BESIDE).cast("int").alias("parts")).filter("parts > 0")
    head = head.join(crowd, "w", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    names = ["cls", "profile", "n", "code", "mark", "left"]
    a = head if some is None else head.join(some, "cls", "left_semi")
    a = a.select("context", "w", F.pmod(F.xxhash64("cls"), F.col("parts") + 1).alias("part"), *[F.col(c).alias(f"{c}1") for c in names])
    b = head.select("w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint"))).alias("part"), *[F.col(c).alias(f"{c}2") for c in names])
    alone = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    most = F.least("left1", "left2", F.col("n1") - alone("mark1", "mark2"), F.col("n2") - alone("mark2", "mark1"))
    other = (F.col("cls1") < F.col("cls2")) if some is None else (F.col("cls1") != F.col("cls2"))
    j = a.join(b, ["w", "part"]).filter(other & (most >= _needed(F.col("n1"), F.col("n2"), s)))
    # as a generator's output the common members are worked out once
    j = j.select("context", "w", "cls1", "profile1", "cls2", "profile2", (F.col("n1") + F.col("n2")).alias("both"), F.inline(F.array(F.struct(F.array_intersect("code1", "code2").alias("common")))))
    shared = F.size("common")
    j = j.filter((F.get("common", F.lit(0)) == F.col("w")) & (shared >= s.min_shared)).withColumn("sim", shared / (F.col("both") - shared)).filter(F.col("sim") >= s.similarity)
    return j.select("context", F.col("cls1").alias("a"), F.col("profile1").alias("p1"), F.col("cls2").alias("b"), F.col("profile2").alias("p2"), "sim")


def similar_profiles(store: DataFrame, s: Settings) -> DataFrame:
    """(context, p1, p2, sim): pairs of different profiles of one context with a similarity of ``similarity`` or more."""
    classes = Work(store.sparkSession, "profiles").put(_classes(_profiled(store, s)).select("context", "profile").withColumn("cls", F.monotonically_increasing_id()))
    free(store.sparkSession)
    pairs = _similar(_encoded(classes, s), s)
    return pairs.select("context", F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2"), "sim")


def analogy(store: DataFrame, s: Settings) -> DataFrame:
    """Subjects of one context with similar predicate sets as structurally similar, in the order of the pairs."""
    if s.cap is None:
        raise ValueError("analogy needs a cap: the pairs of a class of equal profiles are not listed; use similar_profiles")
    work = Work(store.sparkSession, "analogy")
    members = work.put(_profiled(store, s))
    classes = work.put(_classes(members).select("context", "profile").withColumn("cls", F.monotonically_increasing_id()))
    members = work.put(members.join(classes, ["context", "profile"]).select("subject", "context", "cls"))
    encoded = _encoded(classes, s)
    free(store.sparkSession)
    known = store.filter(F.col("predicate") == "structurally_similar_to")
    total = members.count()
    take, each = BLOCK, 4 * s.cap
    while True:
        # pairs in order of the first subject, then the second: the first subjects with their first partners
        first = work.put(members.orderBy("subject", "context").limit(take).select("context", F.col("cls").alias("a"), F.col("subject").alias("s1")))
        some = first.select("a").distinct()
        near = _similar(encoded, s, some.select(F.col("a").alias("cls"))).select("a", "b", "sim").unionByName(some.select("a", F.col("a").alias("b"), F.lit(1.0).alias("sim")))
        later = members.select(F.col("cls").alias("b"), F.col("subject").alias("s2"))
        ranked = later.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy("s2"))).filter(F.col("r") <= take + each).drop("r")
        j = first.join(near, "a").join(ranked, "b").filter("s1 < s2")
        percent = F.format_string("%.0f%%", F.bround(F.col("sim") * 100, 0))
        found = j.select(F.col("s1").alias("subject"), "context", F.lit("structurally_similar_to").alias("predicate"), F.col("s2").alias("object"), F.concat(F.lit("sim="), percent).alias("evidence"))
        out = work.put(_new(found, known, [F.col("subject"), F.col("context"), F.col("object")], s.cap))
        if out.count() >= s.cap or take >= total:
            break
        take, each = take * GROWTH, each * GROWTH
    return out.select(*QUAD, F.lit("T").alias("truth_value"), F.lit(False).alias("needs_verification"), F.lit("idea:analogy").alias("source"), "evidence", F.lit(0).cast("bigint").alias("rank"))


def _rows(found: DataFrame, columns: list[str], generation: int, top: int, cap: int | None) -> DataFrame:
    """Found facts as rows of the store, numbered from ``top`` + 1 in the order in which they fired."""
    order = ["rank", *QUAD]
    if cap is None:
        rows = number(found, order, top + 1)
    else:  # at most ``cap`` rows
        rows = found.withColumn("id", (F.row_number().over(W.orderBy(*order)) + top).cast("bigint"))
    values = {
        "quantifier": F.lit("universal"), "evidence_for": F.array("evidence"), "evidence_against": F.array().cast("array<string>"), "generation": F.lit(generation),
        "grade_level": F.lit(0), "verified": F.lit(False),
    }
    return rows.withColumns(values).select(*columns)


def _insert(store: DataFrame, found: DataFrame, generation: int) -> DataFrame:
    top = store.agg(F.max("id")).first()[0] or 0
    return store.unionByName(_rows(found, store.columns, generation, top, None))


#: Small tables that a growing store may consist of before it is written as one.
MOST_PARTS = 48
#: Changed facts that are left out of older parts by id before the store is written as one.
MOST_CHANGED = 1_000


class Growing:
    """A store that grows by few facts at a time: a large table that is never rewritten for them, small tables of new and
    changed facts, and the ids that these replace."""

    def __init__(self, store: DataFrame):
        self.work = Work(store.sparkSession, "growing")
        self.parts: list[tuple[DataFrame, list[int]]] = [(store, [])]
        most = store.agg(F.max("id"), F.max("generation")).first()
        self.top, self.generation = most[0] or 0, most[1] or 0
        self.columns = store.columns

    def view(self) -> DataFrame:
        """All facts as they stand."""
        if len(self.parts) > MOST_PARTS or sum(len(gone) for _, gone in self.parts) > MOST_CHANGED:
            self.parts = [(self.work.put(self._union()), [])]
        return self._union()

    def _union(self) -> DataFrame:
        return union_all([part.filter(~F.col("id").isin(gone)) if gone else part for part, gone in self.parts])

    def add(self, found: DataFrame, generation: int, cap: int | None) -> int:
        """New facts of a rule; how many."""
        rows = self.work.put(_rows(found, self.columns, generation, self.top, cap))
        n = rows.count()
        if n:
            self.parts.append((rows, []))
            self.top += n
            self.generation = generation
        free(self.work.spark)
        return n

    def change(self, rows: DataFrame) -> None:
        """Few facts (whole rows) that replace those of the same ids."""
        rows = self.work.put(rows.select(*self.columns))
        ids = [r["id"] for r in rows.select("id").collect()]  # a batch of verdicts
        if ids:
            self.parts = [(part, gone + ids) for part, gone in self.parts] + [(rows, [])]


def _pulse(store: Growing, bridges: DataFrame, s: Settings) -> int:
    generation, new = store.generation + 1, 0
    for rule in (merge, transitive, lambda st, x: cross_domain(st, bridges, x).drop("s1", "s2"), analogy):
        new += store.add(rule(store.view(), s), generation, s.cap)
    return new


def pulse(store: DataFrame, bridges: DataFrame, s: Settings | None = None) -> tuple[DataFrame, int]:
    """One pulse: the four rules in order, later ones see the true facts of earlier ones.  (store, new facts)."""
    growing = Growing(store)
    new = _pulse(growing, bridges, s or Settings())
    return growing.view(), new


def run(store: DataFrame, bridges: DataFrame, cycles: int = 5, batch_size: int = 10, s: Settings | None = None, safe: list[str] = V.SAFE_PRODUCTION) -> DataFrame:
    """Pulses and offline verification until a pulse finds nothing and nothing is left open, or ``cycles`` are over."""
    growing = Growing(store)
    for _ in range(cycles):
        new = _pulse(growing, bridges, s or Settings())
        facts = growing.view()
        judged = verify_offline(facts, batch_size, safe).select("id", F.col("truth_value").alias("_t"), F.col("verified").alias("_v"))
        j = facts.join(judged, "id")
        add = F.when(F.col("_v") & (F.col("truth_value") != F.col("_t")), F.array_append("evidence_for", F.lit("auto: safe chain"))).otherwise(F.col("evidence_for"))
        growing.change(j.withColumns({"evidence_for": add, "truth_value": F.col("_t"), "verified": F.col("_v"), "needs_verification": F.lit(False)}))
        if new == 0 and growing.view().filter("truth_value = 'M'").isEmpty():
            break
    return growing.view()


__all__ = ["CAP", "Growing", "Settings", "analogy", "blocked_chains", "chains", "cross_domain", "emergent_bridges", "merge", "profiles", "pulse", "run", "shared_properties", "similar_profiles", "transitive", "union_all"]
