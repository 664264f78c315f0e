"""Typed links between domains: adding, finding and discovering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import vocabulary as V
from rivulet.functions.text import TERM_CHARS, is_atomic, lookup_norm
from rivulet.operators.derived import rows
from rivulet.operators.domains import classify, labelled
from rivulet.tables import SALTS, Work, hot_keys, skew_join, union_all

TYPE_KEY = ["term_a", "term_b", "bridge_type"]


#: Columns of a bridge beside its key, and what stands for a missing value.
_MORE = {"domain_a": "''", "domain_b": "''", "reason": "''", "strength": "0.5D", "bidirectional": "true", "teaching_note": "''", "discovered_by": "'manual'", "examples": "cast(array() as array<string>)"}


def add_bridges(bridges: DataFrame, new: DataFrame, types: list[str] = V.BRIDGE_TYPES, undirected: bool = False) -> DataFrame:
    """Rows of ``new`` that are accepted: known type, and (a, b, type) neither stored nor earlier in ``new`` (by id).

    Terms are compared by the lookup rule.  The key is directed;
    ``undirected`` also refuses reversed duplicates.  Accepted rows have all
    columns of a bridge; those that ``new`` lacks, and nulls, get the default
    (strength 0.5, bidirectional, found by hand, no examples, else empty).
    """

    def keyed(df: DataFrame, more: bool) -> DataFrame:
        a, b = lookup_norm("term_a"), lookup_norm("term_b")
        x, y = (F.least(a, b), F.greatest(a, b)) if undirected else (a, b)
        rest = [F.coalesce(c, F.expr(d)).alias(c) if c in df.columns else F.expr(d).alias(c) for c, d in _MORE.items()] if more else []
        return df.select("id", a.alias("term_a"), b.alias("term_b"), "bridge_type", *rest, x.alias("_x"), y.alias("_y"))

    ok = keyed(new, True).filter(F.col("bridge_type").isin(types) & F.col("term_a").isNotNull() & F.col("term_b").isNotNull())
    rest = [c for c in ok.columns if c not in ("_x", "_y", "bridge_type")]
    first = ok.groupBy("_x", "_y", "bridge_type").agg(F.min_by(F.struct(*rest), "id").alias("b"))
    fresh = first.join(keyed(bridges, False).select("_x", "_y", "bridge_type"), ["_x", "_y", "bridge_type"], "left_anti")
    return fresh.select("b.id", "b.term_a", "b.term_b", "bridge_type", *[f"b.{c}" for c in _MORE])


def new_examples(added: DataFrame, start: int = 0) -> DataFrame:
    """(bridge_id, example, no) of the examples that came with added bridges, in their order."""
    return added.select(F.col("id").alias("bridge_id"), F.posexplode("examples").alias("no", "example")).select("bridge_id", "example", (F.col("no") + start).alias("no"))


def read_bridges(spark: SparkSession, path: str) -> DataFrame:
    """Bridges of JSON files, a list of objects each (one file may span lines); numbered in file order."""
    schema = "term_a string, term_b string, domain_a string, domain_b string, bridge_type string, reason string, strength double, bidirectional boolean, teaching_note string, discovered_by string, examples array<string>"
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("id", F.monotonically_increasing_id())


def find_bridges(bridges: DataFrame, term: str) -> DataFrame:
    """Bridges with the term on either side; strongest first when ordered by strength."""
    key = term.lower().replace(" ", "_")
    return bridges.filter((lookup_norm("term_a") == key) | (lookup_norm("term_b") == key))


def bridges_between(bridges: DataFrame, a: str, b: str) -> DataFrame:
    """Bridges between two domains, in either order."""
    x, y = F.col("domain_a"), F.col("domain_b")
    return bridges.filter(((x == a) & (y == b)) | ((x == b) & (y == a)))


def bridge_stats(bridges: DataFrame) -> DataFrame:
    return bridges.groupBy("bridge_type").agg(F.count(F.lit(1)).alias("n"))


def examples_of(bridges: DataFrame, examples: DataFrame) -> DataFrame:
    """(id, n_examples) of every bridge; counted before the join, so a much used bridge is one row."""
    n = examples.filter("bridge_id is not null").groupBy(F.col("bridge_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return bridges.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_examples"))


#: Bridges of one term that a row lists together, and facts.
BLOCK, TILE = 1024, 256
#: Pairs that one task lists, about.
TASK_PAIRS = 4_000_000


def facts_with_bridges(store: DataFrame, bridges: DataFrame) -> DataFrame:
    """(id, bridge_id): facts whose subject or object is a side of a bridge, each pair once.

    A fact takes the bridges of its first term, and those of its second that do not hold the first too.  So no
    pair comes twice and pairs, of which a term of many facts and bridges makes the product, are never shuffled:
    tiles of facts meet blocks of bridges, and tasks list the pairs of as many of these as make an even share.  A
    bridge stands before all facts of its tile, so the two columns are runs and short repeats, which Parquet packs.
    """
    spark = store.sparkSession
    work = Work(spark, "bridges")
    held = bridges.select(F.col("id").alias("bridge_id"), F.explode(F.array(lookup_norm("term_a"), lookup_norm("term_b"))).alias("term")).filter("term is not null").groupBy("bridge_id").agg(F.collect_set("term").alias("held"))
    held = work.put(held)
    sides = held.select(F.explode("held").alias("term"), "bridge_id")
    many = sides.groupBy("term").agg(F.count(F.lit(1)).alias("b"))
    part = F.pmod(F.xxhash64("bridge_id"), F.ceil(F.col("b") / BLOCK))
    blocks = sides.join(many, "term").groupBy("term", part.alias("part")).agg(F.collect_list(F.struct("bridge_id"))["bridge_id"].alias("those")).drop("part")
    both = held.filter(F.size("held") > 1).select("bridge_id", F.explode("held").alias("term"), "held").select("bridge_id", "term", F.explode("held").alias("first")).filter("first < term").groupBy("first", "term").agg(F.collect_list(F.struct("bridge_id"))["bridge_id"].alias("known"))

    no_terms, none = F.array().cast("array<string>"), F.array().cast(both.schema["known"].dataType)
    ends = store.select("id", F.explode(F.array("subject", "object")).alias("term")).join(sides.select("term").distinct(), "term", "left_semi")
    facts = work.put(ends.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    one = facts.select("id", F.element_at("terms", F.lit(1)).alias("term"), no_terms.alias("firsts"))
    # of several terms each leaves out the bridges of those before it
    more = facts.filter(F.size("terms") > 1).select("id", F.posexplode("terms").alias("i", "term"), "terms").filter("i > 0")
    more = more.select("id", "term", F.explode(F.slice("terms", F.lit(1), F.col("i"))).alias("first")).join(both.select("first", "term", F.col("first").alias("shared")), ["first", "term"], "left").groupBy("id", "term").agg(F.array_sort(F.collect_set("shared")).alias("firsts"))
    rows = work.put(one.unionByName(more))

    counted = work.put(rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(many, "term"))
    total, pairs = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("b")), F.lit(0))).first()
    hot = hot_keys(counted, "term", "n", total)
    salt = F.when(F.col("term").isin(hot), F.pmod(F.xxhash64("id"), F.lit(SALTS))) if hot else F.lit(0)
    lists = rows.groupBy("term", "firsts", salt.alias("_s")).agg(F.collect_list(F.struct("id"))["id"].alias("ids")).drop("_s")
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(TILE))
    tiles = lists.select("term", "firsts", F.explode(F.transform(starts, lambda i: F.slice("ids", i, F.lit(TILE)))).alias("ids"))
    known = rows.filter(F.size("firsts") > 0).select("term", "firsts").distinct().select("term", "firsts", F.explode("firsts").alias("first")).join(both, ["first", "term"]).groupBy("term", "firsts").agg(F.flatten(F.collect_list("known")).alias("known"))
    met = skew_join(tiles.join(known, ["term", "firsts"], "left"), blocks, "term", hot, "inner", "ids")
    fresh = F.when(F.size(F.coalesce("known", none)) == 0, F.col("those")).otherwise(F.array_except("those", "known"))
    tasks = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS), 10_000)
    met = met.select("ids", fresh.alias("those")).repartition(tasks, F.xxhash64(F.get("ids", F.lit(0)), F.get("those", F.lit(0))))
    return met.select("ids", F.explode("those").alias("bridge_id")).select(F.explode("ids").alias("id"), "bridge_id")


def _confidence(p: Column, o: Column) -> Column:
    bonus = F.when(p.isin(V.BRIDGE_PREDICATES), 0.3).otherwise(0.0) + F.when(o.isin(V.STRUCTURAL_WORDS), 0.2).otherwise(0.0) + F.when(F.length(o) > 5, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(0.4) + bonus), 2)


def mechanism_members(store: DataFrame, domains: V.Domains | None = None) -> DataFrame:
    """(predicate, object, domain, subject): atomic subjects of true facts by property and by each of their domain labels,
    generic predicates left out; only properties that several labels share.  This is the membership of
    ``shared_mechanisms``."""
    t = store.filter((F.col("truth_value") == "T") & is_atomic("subject") & ~F.col("predicate").isin(V.NOISE_PREDICATES)).select("subject", "predicate", "object").distinct()
    t = Work(store.sparkSession, "mechanisms").put(t)
    labels = classify(t.select(F.col("subject").alias("term")), domains).filter(F.size("domains") > 0)
    d = labelled(t, "subject", labels, "domains").select("predicate", "object", F.explode("domains").alias("domain"), "subject")
    many = d.groupBy("predicate", "object").agg(F.min("domain").alias("lo"), F.max("domain").alias("hi")).filter("lo < hi").select("predicate", "object")
    return d.join(many, ["predicate", "object"], "left_semi")


def shared_mechanisms(store: DataFrame, domains: V.Domains | None = None) -> DataFrame:
    """(predicate, object, domain_a, domain_b, term_a, term_b, n_pairs, bridge_type, confidence): which two domains share a
    property, how many pairs of different subjects that makes, and the first of these pairs.

    Pairs are counted and never listed: the subjects are in ``mechanism_members``.
    """
    key = ["predicate", "object"]
    d = Work(store.sparkSession, "mechanisms").put(mechanism_members(store, domains))
    first = d.groupBy(*key, "domain").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("m1"))
    second = d.join(first, [*key, "domain"]).filter("subject > m1").groupBy(*key, "domain").agg(F.min("subject").alias("m2"))
    c = first.join(second, [*key, "domain"], "left")
    a, b = c.alias("a"), c.alias("b")  # one row a domain: as many pairs as there are pairs of labels
    j = a.join(b, (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.object") == F.col("b.object")) & (F.col("a.domain") < F.col("b.domain")))
    j = j.select("a.predicate", "a.object", F.col("a.domain").alias("domain_a"), F.col("b.domain").alias("domain_b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.m1").alias("a1"), F.col("a.m2").alias("a2"), F.col("b.m1").alias("b1"), F.col("b.m2").alias("b2"))
    own = d.groupBy(*key, "subject").agg(F.collect_set("domain").alias("ds")).filter(F.size("ds") > 1)  # the labels of one subject
    both = own.select(*key, F.explode("ds").alias("domain_a"), "ds").select(*key, "domain_a", F.explode("ds").alias("domain_b")).filter("domain_a < domain_b").groupBy(*key, "domain_a", "domain_b").agg(F.count(F.lit(1)).alias("nab"))
    j = j.join(both, [*key, "domain_a", "domain_b"], "left").withColumn("n_pairs", F.col("na") * F.col("nb") - F.coalesce("nab", F.lit(0))).filter("n_pairs > 0")
    same = F.col("a1") == F.col("b1")
    kind = F.when(F.col("object").isin(V.STRUCTURAL_WORDS), "structural").otherwise("emergent")
    return j.select(
        *key, "domain_a", "domain_b", F.when(same & F.col("b2").isNull(), F.col("a2")).otherwise(F.col("a1")).alias("term_a"), F.when(same & F.col("b2").isNotNull(), F.col("b2")).otherwise(F.col("b1")).alias("term_b"),
        "n_pairs", kind.alias("bridge_type"), _confidence(F.col("predicate"), F.col("object")).alias("confidence"),
    )


def bridge_predicates(store: DataFrame, predicates: list[str] = V.BRIDGE_PREDICATES) -> DataFrame:
    """(term_a, term_b, predicate, bridge_type, confidence): facts that state a bridge themselves."""
    t = store.filter((F.col("truth_value") == "T") & F.col("predicate").isin(predicates))
    return t.select(F.col("subject").alias("term_a"), F.col("object").alias("term_b"), "predicate", F.lit("inspirational").alias("bridge_type"), F.lit(0.7).alias("confidence")).distinct()


def structural_members(store: DataFrame, domains: V.Domains | None = None, words: list[str] = V.STRUCTURAL_WORDS) -> DataFrame:
    """(subject, domains, words): atomic subjects of known domains with the structural words that their objects hold."""
    held = F.filter(F.array(*[F.when(F.contains("object", F.lit(w)), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    t = store.filter((F.col("truth_value") == "T") & is_atomic("subject")).select("subject", F.explode(held).alias("word")).groupBy("subject").agg(F.array_sort(F.collect_set("word")).alias("words"))
    t = Work(store.sparkSession, "structural").put(t)
    labels = classify(t.select(F.col("subject").alias("term")), domains).filter(F.size("domains") > 0).select(F.col("term").alias("subject"), "domains")
    return t.join(labels, "subject").select("subject", "domains", "words")


def structural_patterns(store: DataFrame, domains: V.Domains | None = None, words: list[str] = V.STRUCTURAL_WORDS) -> DataFrame:
    """(term_a, term_b, n_shared, n_pairs, confidence): subjects of different domain sets whose objects hold the same
    structural words; confidence min(0.3 + 0.15 n, 0.9).

    Subjects with equal domains and words are one class, named by its first
    subject; pairs are those of classes, with the number of subject pairs that
    they stand for.  The members are in ``structural_members``.
    """
    c = structural_members(store, domains, words).groupBy("domains", "words").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first"))
    c = Work(store.sparkSession, "structural").put(c)
    w = c.select("domains", "words", "n", "first", F.explode("words").alias("word"))
    a, b = w.alias("a"), w.alias("b")
    j = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.first") < F.col("b.first")) & (F.col("a.domains") != F.col("b.domains")))
    j = j.groupBy(F.col("a.first").alias("term_a"), F.col("b.first").alias("term_b"), (F.col("a.n") * F.col("b.n")).alias("n_pairs")).agg(F.count(F.lit(1)).alias("n_shared"))
    return j.select("term_a", "term_b", "n_shared", "n_pairs", F.round(F.least(F.lit(0.9), 0.3 + 0.15 * F.col("n_shared")), 2).alias("confidence"))


def potential_bridges(store: DataFrame, domains: V.Domains | None = None) -> DataFrame:
    """(term_a, term_b, strategy, bridge_type, confidence): one row per unordered pair; shared mechanisms come before
    stated bridges, these before structural patterns, each by confidence.  The pairs of the first and the last stand for
    their classes."""
    pick = lambda df, n, kind: df.select("term_a", "term_b", F.lit(n).alias("strategy"), kind.alias("bridge_type"), "confidence")
    every = union_all([
        pick(shared_mechanisms(store, domains), 1, F.col("bridge_type")),
        pick(bridge_predicates(store), 2, F.col("bridge_type")),
        pick(structural_patterns(store, domains), 3, F.lit("structural")),
    ])
    best = every.groupBy(F.least("term_a", "term_b").alias("x"), F.greatest("term_a", "term_b").alias("y")).agg(F.min_by(F.struct("strategy", "bridge_type", "confidence"), F.struct("strategy", -F.col("confidence"), "bridge_type")).alias("b"))
    return best.select(F.col("x").alias("term_a"), F.col("y").alias("term_b"), "b.*")


def _substrings(c: str, sizes: Column) -> Column:
    """All substrings of a value with the given sizes, each once."""
    n = F.length(c)
    per = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(c), i, k))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda k: k <= n), per)))


def relevant_bridges(bridges: DataFrame, terms: DataFrame) -> DataFrame:
    """Bridges with a side that equals a term of the knowledge base, holds one, or stands in one.

    ``terms`` has the column ``term``, in insert normalisation.  Null and empty sides and terms match
    nothing.  Substrings are joined by equality, so the work grows with the
    distinct terms and never with terms times bridges.
    """
    known = terms.filter(F.length("term") > 0).select("term").distinct()
    sides = bridges.select("id", F.explode(F.array(lookup_norm("term_a"), lookup_norm("term_b"))).alias("side")).filter(F.length("side") > 0)
    distinct = sides.select("side").distinct()
    holding = distinct.select("side", F.explode(_substrings("side", F.sequence(F.lit(1), F.least(F.length("side"), F.lit(TERM_CHARS))))).alias("term")).join(known, "term", "left_semi").select("side")
    # only substrings as long as some side can be one
    sizes = sorted(r["n"] for r in distinct.select(F.length("side").alias("n")).filter(F.col("n") <= TERM_CHARS).distinct().collect())  # at most TERM_CHARS rows
    inside = known.select(F.explode(_substrings("term", F.array(*[F.lit(n) for n in sizes]).cast("array<int>"))).alias("side")).join(distinct, "side", "left_semi")
    hit = sides.join(holding.unionByName(inside).distinct(), "side", "left_semi").select("id").distinct()
    return bridges.join(hit, "id", "left_semi")


def cross_pattern_candidates(store: DataFrame, domains: V.Domains | None = None) -> DataFrame:
    """(subject, term_a, term_b): pair subjects 'a,b' whose two terms have known, different domain sets."""
    pairs = store.filter("subject like '%,%' and predicate like 'both\\_%'").select("subject").distinct()
    pairs = pairs.select("subject", F.get(F.split("subject", ","), F.lit(0)).alias("term_a"), F.get(F.split("subject", ","), F.lit(1)).alias("term_b"))
    labels = classify(pairs.select(F.explode(F.array("term_a", "term_b")).alias("term")), domains).filter(F.size("domains") > 0)
    a = labels.select(F.col("term").alias("term_a"), F.col("domains").alias("da"))
    b = labels.select(F.col("term").alias("term_b"), F.col("domains").alias("db"))
    return pairs.join(a, "term_a").join(b, "term_b").filter("da <> db").select("subject", "term_a", "term_b")


def seed_bridges(spark: SparkSession) -> DataFrame:
    """A few bridges of this library's own to start with (term_a, term_b, domain_a, domain_b, bridge_type, reason, strength)."""
    seeds = [
        ("river_delta", "lung", "geography", "biology", "pattern", "both branch to reach a whole area", 0.7),
        ("water_cycle", "market", "earth_science", "economics", "structural", "flows, stores and feedback", 0.5),
        ("valve", "heart", "engineering", "biology", "technological", "one-way passages", 0.8),
        ("wave", "rumour", "physics", "psychology", "metaphorical", "spreads and fades", 0.4),
        ("current", "current_account", "physics", "economics", "etymological", "from running water", 0.5),
        ("tide", "moon", "earth_science", "astronomy", "causal", "pulled by gravity", 0.9),
        ("irrigation", "tax", "agriculture", "politics", "historical", "canals needed administration", 0.6),
        ("erosion", "forgetting", "earth_science", "psychology", "metaphorical", "slow loss of form", 0.4),
        ("well", "patience", "everyday", "philosophy", "philosophical", "depth takes time", 0.3),
        ("ice", "glass", "chemistry", "materials", "sensory", "clear, cold and hard", 0.4),
    ]
    return rows(spark, seeds, "term_a string, term_b string, domain_a string, domain_b string, bridge_type string, reason string, strength double").withColumn("strength", F.col("strength").cast("double"))
