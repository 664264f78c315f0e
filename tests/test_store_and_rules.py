import random

import pytest
from pyspark.sql import functions as F

from rivulet import catalog
from rivulet import vocabulary as V
from rivulet.functions.hashing import fnv_batch
from rivulet.functions.porter import stem
from rivulet.functions.text import insert_norm, insert_norm_py
from rivulet.operators import bridges, derived, domains, fulltext, gates, graph, lookups
from rivulet.plans import pulse, store
from rivulet.tables import Work

from .conftest import collected

ENTRY = "id long, subject string, context string, predicate string, object string, quantifier string, truth_value string, evidence_for array<string>, evidence_against array<string>, source string, generation int, grade_level int, verified boolean, needs_verification boolean"


def kb(spark, quads, truth="T"):
    rows = [(i, s, c, p, o, None, truth, None, None, None, 0, 0, False, truth == "M") for i, (s, c, p, o) in enumerate(quads, 1)]
    return store.facts(spark.createDataFrame(rows, ENTRY))


@pytest.mark.parametrize("value", ["  Caused By! ", "HAS – Part", "e-mail", "__x__", "", None, "Ünï_ccode", "a,b , c", "x" * 300, "﻿q​", "- -"])
def test_insert_norm(spark, value):
    got = spark.createDataFrame([(value,)], "v string").select(insert_norm("v")).first()[0]
    assert (got or "") == insert_norm_py(value)


GATE_CASES = [
    ("is_a", "is_a", True), ("is_a", "has_property", True), ("is_a", "has_formula", True), ("is_a", "enables", True), ("uses", "boils_at", False),
    ("uses", "has_formula", False), ("uses", "has_state", False), ("uses", "freezes_at", False), ("uses", "has_property", False), ("uses", "covers", False),
    ("symbolizes", "boils_at", False), ("uses", "essential_for", True), ("uses", "is_a", True), ("causes", "enables", True), ("causes", "caused_by", True),
    ("has_part", "is_a", True), ("made_of", "has_formula", True), ("predecessor_of", "has_state", False), ("associated_with", "boils_at", False), ("causes", "has_depth", False),
]


def test_gate_cases(spark):
    df = spark.createDataFrame(GATE_CASES, "link string, inherited string, expected boolean")
    got = df.withColumn("ok", gates.Rules().allows(F.col("link"), F.col("inherited")))
    assert got.filter("ok <> expected").count() == 0


def test_learned_rules(spark):
    o = spark.createDataFrame([("likes", "weighs_as", False)] * 6 + [("uses", "boils_at", True)] * 6 + [("a", "b", True)], "link string, inherited string, approved boolean")
    s = gates.suggest_rules(gates.pair_stats(o))
    assert {(r["link"], r["suggestion"]) for r in s.collect()} == {("likes", "block"), ("uses", "allow"), ("a", "uncertain")}
    learned = gates.apply_rules(gates.Rules(), s)
    assert "likes" in learned.opaque and "weighs_as" in learned.intrinsic and "likes" not in gates.Rules().opaque
    one = spark.range(1)
    assert not one.select(learned.allows(F.lit("uses"), F.lit("boils_at"))).first()[0]
    assert one.select(gates.apply_rules(gates.Rules(), s, unblock=True).allows(F.lit("uses"), F.lit("boils_at"))).first()[0]


def test_scope_cases(spark):
    good = [("transformer", "uses", "attention"), ("transformer", "is_a", "neural_network"), ("dog", "eats", "bone"), ("photosynthesis", "produces", "glucose"), ("gravity", "causes", "acceleration")]
    bad = [("orange", "trains_via", "backpropagation"), ("cake", "compiles_to", "assembly"), ("dog", "orbits", "sun"), ("france", "reacts_with", "oxygen"), ("neural_network", "eats", "gradient")]
    df = spark.createDataFrame(good + bad, "subject string, predicate string, object string")
    reasons = {tuple(r)[:3]: r["reason"] for r in domains.nonsense(df).select("subject", "predicate", "object", "reason").collect()}
    assert all(reasons[g] == "ok" for g in good) and all(reasons[b] != "ok" for b in bad)


def test_contexts_do_not_leak(spark):
    rows = [
        ("mamba", "computer_science", "is_a", "ssm_architecture"), ("mamba", "computer_science", "uses", "selective_state_spaces"), ("mamba", "biology", "is_a", "venomous_snake"),
        ("mamba", "biology", "has_property", "neurotoxic_venom"), ("ssm_architecture", "computer_science", "is_a", "neural_network_variant"), ("venomous_snake", "biology", "is_a", "reptile"),
    ]
    got = collected(pulse.transitive(kb(spark, rows), pulse.Settings()).select(*store.QUAD))
    assert got == [("mamba", "biology", "is_a", "reptile"), ("mamba", "computer_science", "is_a", "neural_network_variant")]


def model_transitive(facts, cap):
    """Straight loop over facts (id, s, ctx, p, o) by the rule's text."""
    rules, have, out = gates.Rules(), {f[1:] for f in facts}, []
    closed = {*rules.opaque, *rules.semi}

    def allowed(a, b):
        if a in rules.transparent or (a in rules.semi and b in rules.identity):
            return True
        if a in closed and b in rules.intrinsic:
            return False
        return "profile_size" not in (a, b) or (a in closed and b in rules.relational)

    for i, s, c, p, o in sorted(facts):
        for j, s2, c2, p2, o2 in sorted(facts, key=lambda f: (f[2], f[0])):
            if s2 == o and (c == c2 or "general" in (c, c2)) and s != o2 and (s, c, p2, o2) not in have and allowed(p, p2):
                have.add((s, c, p2, o2))
                out.append((s, c, p2, o2))
    return out[:cap]


def test_transitive_against_model(spark, monkeypatch):
    import random

    r = random.Random(3)
    quads = sorted({(f"t{r.randrange(25)}", r.choice(["general", "physics"]), r.choice(["is_a", "uses", "has_property", "has_part"]), f"t{r.randrange(25)}") for _ in range(120)})
    monkeypatch.setattr(pulse, "BLOCK", 5)
    for cap in (7, 50):
        got = [tuple(x) for x in pulse.transitive(kb(spark, quads), pulse.Settings(cap=cap)).select(*store.QUAD).collect()]
        assert sorted(got) == sorted(model_transitive([(i, *q) for i, q in enumerate(quads, 1)], cap))


def test_pulse_grows_and_converges(spark):
    quads = [("dog", "biology", "is_a", "mammal"), ("mammal", "biology", "is_a", "animal"), ("cat", "biology", "is_a", "mammal"), ("dog", "biology", "eats", "meat"), ("cat", "biology", "eats", "meat"), ("dog", "biology", "eats", "bone")]
    s = kb(spark, quads)
    none = spark.createDataFrame([], "id long, term_a string, term_b string")
    first, new = pulse.pulse(s, none)
    assert new > 0 and first.select(*store.QUAD).distinct().count() == first.count()
    got = collected(first.filter("source = 'idea:merge'").select("object", "evidence_for"))
    assert got == [("bone,meat", ["merged 2"])]
    done = pulse.run(s, none, cycles=4)
    assert pulse.pulse(done, none)[1] >= 0 and done.filter("needs_verification").count() == 0


def test_append_is_idempotent(spark):
    a = kb(spark, [("a", "x", "p", "b")])
    batch = spark.createDataFrame([(9, " A ", "x", "P", "B!", *[None] * 9), (10, "c", None, "p", "d", *[None] * 9), (11, "C", "general", "p", "d", *[None] * 9), (12, "", "x", "p", "o", *[None] * 9)], ENTRY)
    new = store.append(a, batch)
    assert [r["input_id"] for r in new.collect()] == [10]
    assert store.append(a.unionByName(new.withColumnRenamed("input_id", "id")), batch).count() == 0
    assert sorted(r["id"] for r in store.number(new, ["input_id"], 5).collect()) == [5]


def test_empty_store(spark):
    e = kb(spark, [])
    b = spark.createDataFrame([], "id long, term_a string, term_b string, domain_a string, domain_b string, bridge_type string, strength double")
    s = pulse.Settings()
    for df in (pulse.merge(e, s), pulse.transitive(e, s), pulse.cross_domain(e, b, s), pulse.analogy(e, s), pulse.blocked_chains(e, s), derived.build_hierarchy(e), derived.domain_clusters(e), graph.neighbors(e, "x", 2), lookups.raw_lookup(e, b, "x"), bridges.potential_bridges(e)):
        assert df.count() == 0
    assert derived.build_synonyms(e).count() == 44


def test_path_and_neighbours(spark):
    s = kb(spark, [("a", "general", "p", "b"), ("c", "general", "q", "b"), ("c", "general", "p", "d"), ("d", "general", "p", "e"), ("x,y", "general", "p", "a")])
    assert [tuple(r) for r in graph.find_path(s, "A", "d").collect()] == [(3, "a --p--> b --q--> c --p--> d")]
    assert graph.find_path(s, "a", "e").count() == 0
    assert {r["depth"] for r in graph.neighbors(s, "a", 3).collect()} == {1, 2, 3}


def test_porter_and_fnv():
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "hopefulness": "hope"}
    assert {w: stem(w) for w in words} == words

    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    values = ["", "water", "a|b|c|d", "é水", None, "x" * 50]
    assert list(fnv_batch(values)) == [fnv(v or "") for v in values]


def test_upsert_concepts_keeps_whole_definitions(spark, tmp_path):
    long = "A basin is " + "wide and deep, " * 200
    rows = [(1, "basin", "general", "old", "a"), (2, "basin", "general", long, "b"), (3, "tide", "physics", "short", "c"), (4, "tide", "physics", None, "d")]
    spark.createDataFrame(rows, "doc_id long, subject string, context string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert collected(catalog.upsert_concepts(spark, str(tmp_path))) == [("basin", "general", long, "b"), ("tide", "physics", "short", "c")]


def test_later_pulses_of_a_large_group(spark):
    """Every capped pulse is the uncapped rule cut at the cap, when pairs of the first members are known already."""
    quads = [("a", "g", "p", "x"), ("b", "g", "p", "x")] + [(f"m{i:03}", "g", "has_part", "basin") for i in range(200)] + [("c", "g", "q", "y"), ("d", "g", "q", "y")]
    s = kb(spark, quads)
    none = spark.createDataFrame([], "term_a string, term_b string")
    with pytest.raises(ValueError, match="cap"):
        pulse.cross_domain(s, none, pulse.Settings(cap=None))
    groups = {(r["predicate"], r["object"]): (r["n"], r["n_links"]) for r in pulse.shared_properties(s, pulse.Settings(group_max=1000)).collect()}
    assert groups == {("p", "x"): (2, 1), ("has_part", "basin"): (200, 199), ("q", "y"): (2, 1)}
    for _ in range(3):
        capped = pulse.cross_domain(s, none, pulse.Settings(group_max=1000))
        every = pulse.cross_domain(s, none, pulse.Settings(group_max=1000, cap=1_000_000))
        first = sorted((r["rank"], r["s1"], r["s2"], r["subject"]) for r in every.collect())[:50]
        assert sorted((r["rank"], r["s1"], r["s2"], r["subject"]) for r in capped.collect()) == first
        s = Work(spark, "test").put(pulse._insert(s, capped.drop("s1", "s2"), 1))


def test_search_index(spark):
    s = kb(spark, [("running_water", "general", "p", "cafe_wall"), ("wall", "general", "p", "water_run"), ("big", "general", "p", "stone")])
    i = fulltext.build_index(s)
    assert [r["id"] for r in fulltext.search_index(s, i, ["runs water"]).collect()] == [1]
    assert [r["id"] for r in fulltext.search_index(s, i, ["Café"]).collect()] == [1]
    syn = spark.createDataFrame([("huge", "big")], "term string, synonym string")
    assert [r["id"] for r in fulltext.search_index(s, i, ["huge"], syn).collect()] == [3]


def test_search_expands_with_every_synonym(spark, tmp_path):
    """Children and parts of a term count as its manual synonyms do."""
    quads = [("rock_pool", "g", "is_a", "tidal_basin"), ("crab", "g", "lives_in", "rock_pool"), ("tidal_basin", "g", "has_part", "sea-gate"), ("lock", "g", "near", "sea_gate"), ("lock", "g", "in", "pool_rock"), ("snail", "g", "p", "sluggish")]
    rows = [(i, *q[:4], None, "T", None, None, None, 0, 0, False, False) for i, q in enumerate(quads, 1)]
    spark.createDataFrame(rows, ENTRY).write.parquet(f"{tmp_path}/entries.parquet")
    assert sorted(r["id"] for r in catalog.fts_search(spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 6]


def test_search_with_many_synonyms(spark):
    n = 1200
    s = kb(spark, [(f"thing_{i}", "g", "p", f"w{i}_x{i}") for i in range(n)] + [("other", "g", "p", "w1_y_x1")])
    syn = spark.createDataFrame([("huge", f"w{i}_x{i}") for i in range(n)], "term string, synonym string")
    got = [r["id"] for r in fulltext.search_index(s, fulltext.build_index(s), ["huge"], syn).collect()]
    assert sorted(got) == list(range(1, n + 1))


def test_relevant_bridges_by_objects_and_short_terms(spark, tmp_path):
    quads = [("ice", "g", "p", "sea"), ("water", "g", "p", "salt_marsh")]
    rows = [(i, *q, None, "T", None, None, None, 0, 0, False, False) for i, q in enumerate(quads, 1)]
    spark.createDataFrame(rows, ENTRY).write.parquet(f"{tmp_path}/entries.parquet")
    b = [(1, "ICE", "q"), (2, "q", "sea"), (3, "marsh", None), (4, "ice_age", "y"), (5, "hot waterfall", "y"), (6, "z", None), (7, "alt", ""), (8, "", None), (9, "y" * 300 + "ice", None), (10, "seaa", "z"), (11, "mars_h", "z")]
    spark.createDataFrame(b, "id long, term_a string, term_b string").write.parquet(f"{tmp_path}/bridges.parquet")
    assert sorted(r["id"] for r in catalog.bridge_relevant(spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5, 7, 9, 10]


def test_bridges(spark):
    b = spark.createDataFrame([(1, "a", "b", "scale", 0.5)], "id long, term_a string, term_b string, bridge_type string, strength double")
    new = spark.createDataFrame([(2, "A", "b", "scale", None), (3, "b", "a", "scale", None), (4, "c", "d", "nonsense", None), (5, "c", None, "scale", None), (6, "b", "a", "scale", 1.0)], b.schema)
    assert [r["id"] for r in bridges.add_bridges(b, new).collect()] == [3]
    assert bridges.add_bridges(b, new, undirected=True).count() == 0


def test_domain_dictionary(tmp_path):
    d = V.Domains()
    scores = {(a, b): s for a, b, s in d.matrix()}
    assert scores["mathematics", "chemistry"] == 0.7 and scores["chemistry", "mathematics"] == 0.3 and scores["physics", "physics"] == 1.0
    (tmp_path / "d.json").write_text('{"keywords": {"physics": ["quark"]}}')
    assert V.Domains.from_json(str(tmp_path / "d.json")).keyword_rows() == [("quark", "physics")]


class Echo:
    """A model for tests: knows one fact and judges everything false."""

    def ask(self, prompt):
        return "VERDICT: F\nREASON: no" if prompt.startswith("Is this") else "FACTS:\n- rain | causes | flood\nCONFUSED:\n- tide | wave | both move\nnone"


def test_curriculum_and_model(spark):
    from rivulet.plans import curriculum, language_model

    s = kb(spark, [("dog", "biology", "is_a", "mammal"), ("mammal", "biology", "is_a", "animal")])
    none = spark.createDataFrame([], "id long, term_a string, term_b string")
    grades = [curriculum.Grade(1, "first", ["rain"], ["why?"])]
    done, report, confusions = curriculum.run(s, none, grades, pulses=1, after=1, model=Echo())
    got = {(r["subject"], r["object"]): r["truth_value"] for r in done.collect()}
    assert got["rain", "flood"] == "T" and got["dog", "animal"] == "F" and report.first()["grade"] == 1
    rain = done.filter("subject = 'rain'").first()
    assert (rain["source"], rain["evidence_for"], rain["grade_level"]) == ("curriculum:grade_1", ["curriculum: first, topic: rain"], 1)
    assert [tuple(r)[1:] for r in confusions.collect()] == [("tide", "wave", "both move", 1)]
    v = language_model.verify(done.filter("source = 'idea:transitive'"), Echo())
    assert [(r["link"], r["inherited"], r["approved"]) for r in language_model.outcomes(done, v).collect()] == [("is_a", "is_a", False)]
    offline, _, _ = curriculum.run(s, none, grades, pulses=1, after=0)
    assert {(r["subject"], r["object"]): r["truth_value"] for r in offline.collect()}["dog", "animal"] == "T"
    assert language_model.verify(s).count() == 0


def test_journal(spark):
    from rivulet.operators import journal

    log = spark.createDataFrame([(i, "e", 0, "m") for i in range(5)], "id long, event_type string, grade_level int, message string")
    assert [r["id"] for r in journal.recent(journal.append_log(log, log), 3).collect()] == [4, 4, 3]
    ing = spark.createDataFrame([("json", 3, None), ("json", None, 1)], "source_type string, facts_added long, errors long")
    assert [tuple(r) for r in journal.ingest_summary(ing).collect()] == [("json", 2, 3, 1)]


def test_bridge_columns_and_examples(spark):
    schema = "id long, term_a string, term_b string, bridge_type string, strength double"
    old = spark.createDataFrame([], schema)
    new = spark.createDataFrame([(1, "a", "b", "scale", 0.7, "physics", "why", False, ["one", "two"])], schema + ", domain_a string, reason string, bidirectional boolean, examples array<string>")
    r = bridges.add_bridges(old, new).first()
    assert (r["domain_a"], r["domain_b"], r["reason"], r["strength"], r["bidirectional"], r["teaching_note"], r["discovered_by"]) == ("physics", "", "why", 0.7, False, "", "manual")
    assert collected(bridges.new_examples(bridges.add_bridges(old, new))) == [(1, "one", 0), (1, "two", 1)]


def test_read_bridges(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"term_a": "wave", "term_b": "rumour", "bridge_type": "metaphorical", "reason": "spreads"}, {"term_a": "x", "term_b": "y", "bridge_type": "odd"}]')
    read = bridges.read_bridges(spark, str(tmp_path))
    none = read.filter("false")
    assert [(r["term_a"], r["reason"], r["strength"]) for r in bridges.add_bridges(none, read).collect()] == [("wave", "spreads", 0.5)]


def test_mechanisms_as_classes(spark):
    """Pairs are counted, not listed: the number of pairs and the first pair of each two domains against all pairs."""
    r = random.Random(3)
    names = ["energy_a", "wave_b", "acid_c", "cell_d", "pump_e", "delta_pump", "wave_acid", "spring_f", "x"]
    quads = [(f"{r.choice(names)}_{r.randrange(4)}", "g", r.choice(["drives", "moves"]), r.choice(["flow", "channel_long"])) for _ in range(80)]
    s = kb(spark, list(dict.fromkeys(quads)))
    members = [tuple(x) for x in bridges.mechanism_members(s).select("predicate", "object", "domain", "subject").collect()]
    pairs: dict = {}
    for p, o, d1, s1 in members:
        for q, v, d2, s2 in members:
            if (p, o) == (q, v) and d1 < d2 and s1 != s2:
                pairs.setdefault((p, o, d1, d2), []).append((s1, s2))
    got = {(x["predicate"], x["object"], x["domain_a"], x["domain_b"]): (x["term_a"], x["term_b"], x["n_pairs"]) for x in bridges.shared_mechanisms(s).collect()}
    assert got == {k: (*min(v), len(v)) for k, v in pairs.items()} and got
    words = ["flow", "channel", "long"]
    subjects = {x["subject"]: (tuple(x["domains"]), set(x["words"])) for x in bridges.structural_members(s, words=words).collect()}
    total = sum(1 for a in subjects for b in subjects if a < b and subjects[a][0] != subjects[b][0] and subjects[a][1] & subjects[b][1])
    assert sum(x["n_pairs"] for x in bridges.structural_patterns(s, words=words).collect()) == total > 0


def test_scoped_insert(spark):
    s = kb(spark, [("tide", "g", "moves", "sand")])
    schema = "id long, subject string, context string, predicate string, object string, truth_value string, needs_verification boolean"
    rows = [(1, "nebula,terrace", "g", "both_has", "metaphor", "T", False), (2, "energy,wave", "g", "both_has", "gravity", "T", False), (3, "tide", "other", "moves", "sand", "T", False), (4, "a", "g", "is", "b", "T", False), (5, "energy,wave", "h", "both_has", "gravity", "T", False), (6, "u,v,w", "g", "both_p", "metaphor", "T", False)]
    facts = spark.createDataFrame(rows, schema)
    profile = domains.predicate_profile(s)
    ok, bad = domains.scoped_insert(s, facts, "cross_domain", profile)
    assert sorted(r["id"] for r in ok.collect()) == [2, 6] and {r["id"]: r["reason"] for r in bad.collect()} == {1: "cross gate", 4: "term too short"}
    ok, bad = domains.scoped_insert(s, facts, "cross_domain", profile, skip=True)
    assert sorted(r["id"] for r in ok.collect()) == [1, 2, 4, 6] and bad.count() == 0
    ok, bad = domains.scoped_insert(s, facts, None, profile)
    assert sorted(r["id"] for r in ok.collect()) == [1, 2, 6]
    learned = spark.createDataFrame([("tide", "astronomy")], "term string, domain string")
    assert domains.with_domains(s, learned=learned).first()["s_domains"] == ["astronomy"]


def test_paths_along_facts_only(spark):
    s = kb(spark, [("a", "general", "p", "b"), ("c", "general", "q", "b"), ("b", "general", "p", "d")])
    assert [r["path"] for r in graph.find_path(s, "a", "d", outgoing_only=True).collect()] == ["a --p--> b --p--> d"]
    assert graph.find_path(s, "a", "c", outgoing_only=True).count() == 0 and graph.find_path(s, "a", "c").count() == 1


def test_learned_rules_are_all_applied(spark):
    rows = [("is_a", f"p{i}", "block") for i in range(300)] + [("odd", "q", "block"), ("uses", "r", "allow"), ("x", "y", "uncertain")]
    r = gates.apply_rules(gates.Rules(), spark.createDataFrame(rows, "link string, inherited string, suggestion string"), unblock=True)
    assert {f"p{i}" for i in range(300)} <= set(r.intrinsic) and "odd" in r.opaque and "r" in r.relational and r.allowed == [("uses", "r")] and "y" not in r.intrinsic


def test_a_growing_store_equals_one_that_is_rewritten(spark, monkeypatch):
    quads = [(f"s{i % 7}", "general", p, f"s{(i * 3 + 1) % 7}") for i in range(12) for p in ("is_a", "uses", "has_part")] + [("m1", "g", "has_part", "x"), ("m2", "g", "has_part", "x")]
    s = kb(spark, list(dict.fromkeys(quads)))
    b = spark.createDataFrame([], "term_a string, term_b string")
    columns = ["id", "subject", "context", "predicate", "object", "truth_value", "verified", "needs_verification", "generation", "source"]
    got = collected(pulse.run(s, b, cycles=3, batch_size=4).select(*columns))
    monkeypatch.setattr(pulse, "MOST_PARTS", 1)  # a rewrite before every rule
    assert got == collected(pulse.run(s, b, cycles=3, batch_size=4).select(*columns))
    assert len({r[0] for r in got}) == len(got) and len({r[1:5] for r in got}) == len(got) and len(got) > s.count()


def test_seed_bridges(spark):
    seeds = bridges.seed_bridges(spark)
    assert seeds.count() == 10 and seeds.filter(~F.col("bridge_type").isin(V.BRIDGE_TYPES)).count() == 0
    assert bridges.find_bridges(seeds, "Water Cycle").count() == 1


def test_displays(spark):
    from rivulet.operators import displays

    b = spark.createDataFrame([(1, "a", "b", "", None, "scale", None, 0.72, ""), (2, None, "b", None, None, None, "why", None, "note"), (3, "c", "d", "x", "", "scale", "", 1.0, None)], "id long, term_a string, term_b string, domain_a string, domain_b string, bridge_type string, reason string, strength double, teaching_note string")
    got = {r["id"]: tuple(r)[1:] for r in displays.bridges_shown(b).collect()}
    assert got[1] == ("a ↔ b", "scale", 0.72, "█" * 7 + "░" * 3, "", "no reason given", "")
    assert got[2] == ("? ↔ b", "?", 0.5, "█" * 5 + "░" * 5, "", "why", "note") and got[3][3:5] == ("█" * 10, "x ↔ ?")
    s = kb(spark, [("m", "g", "p", "x"), ("m", "h", "p", "y"), ("n", "g", "p", "x")], "M")
    assert [r["shown"] for r in displays.unresolved_shown(s).orderBy("id").collect()] == ["m (g) → p(x)", "m (h) → p(y)", "n → p(x)"]
    stats = spark.createDataFrame([("l", "i", 1, 4, 5), ("l", "j", 4, 1, 5), ("l", "k", 1, 0, 1), ("l", "z", 0, 0, 0)], "link string, inherited string, approved long, rejected long, total long")
    assert collected(displays.learner_report(stats)) == [("allow", "l", "j", 0.8, 5), ("block", "l", "i", 0.8, 5), ("uncertain", "l", "k", 1.0, 1)]
    none = spark.createDataFrame([("a", "b", None)], "subject string, confused_with string, reason string")
    assert collected(displays.confusions_shown(none)) == [("a ≠ b", "")] and displays.candidates_shown(s.filter("false")).count() == 0


@pytest.mark.parametrize("similarity, least, shared", [(0.6, 1, 1), (0.3, 3, 2), (0.5, 1, 1)])
def test_similar_profiles_are_met_once_and_in_parts(spark, monkeypatch, similarity, least, shared):
    monkeypatch.setattr(pulse, "BESIDE", 3)  # crowded predicates are compared in parts
    rnd = random.Random(7)
    quads = [(f"s{i}", f"c{i % 2}", p, "o") for i in range(60) for p in rnd.sample([f"p{k}" for k in range(9)], rnd.randrange(1, 7))]
    quads += [("hub", "c0", f"h{k}", "o") for k in range(80)]  # no other set is near its size
    got = collected(pulse.similar_profiles(kb(spark, quads), pulse.Settings(similarity=similarity, min_profile=least, min_shared=shared)).select("context", F.array_join("p1", ","), F.array_join("p2", ","), F.round("sim", 6)))
    sets = {}
    for s, c, p, _ in quads:
        sets.setdefault((c, s), set()).add(p)
    of = {(c, tuple(sorted(p))) for (c, _), p in sets.items() if len(p) >= least}
    want = [(c, ",".join(x), ",".join(y), round(len({*x} & {*y}) / len({*x} | {*y}), 6)) for c, x in of for d, y in of if c == d and x < y and len({*x} & {*y}) >= max(shared, similarity * len({*x} | {*y}) - 1e-9)]
    assert got == sorted(want, key=repr) != []


def test_analogy_compares_the_first_subjects_only(spark, monkeypatch):
    quads = [(f"s{i:03}", "c", p, "o") for i in range(120) for p in ("a", "b", "c", "d", f"r{i % 40}")]
    monkeypatch.setattr(pulse, "BLOCK", 2)
    monkeypatch.setattr(pulse, "similar_profiles", None)  # all pairs
    e = kb(spark, quads)
    got = [(r["subject"], r["object"]) for r in pulse.analogy(e, pulse.Settings(cap=7)).orderBy("subject", "object").collect()]
    assert got == [("s000", f"s{i:03}") for i in range(1, 8)]
    known = e.unionByName(kb(spark, [("s000", "c", "structurally_similar_to", "s001")]).withColumn("id", F.lit(10_000).cast("bigint")))
    assert pulse.analogy(known, pulse.Settings(cap=3)).agg(F.min("object")).first()[0] == "s002"


def test_facts_with_bridges_lists_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(bridges, "BLOCK", 2)  # the bridges of a term in several blocks
    e = kb(spark, [("a", "g", "p", "b"), ("b", "g", "p", "a"), ("a", "g", "p", "a"), ("a", "g", "p", "c"), ("x", "g", "p", "y")])
    e = e.unionByName(e.filter("subject = 'x'").withColumns({"id": F.lit(1).cast("bigint"), "object": F.lit("c")}))  # an id twice
    b = [(1, "A", "b"), (2, "b", "a"), (3, "a", "a"), (4, "a", None), (5, "c", "q"), (6, "a", "z"), (7, None, None), (8, "y z", "y"), (8, "c", "c")]
    table = spark.createDataFrame(b, "id long, term_a string, term_b string")
    got = collected(bridges.facts_with_bridges(e, table))
    want = {(r["id"], i) for r in e.collect() for i, *ts in b if {r["subject"], r["object"]} & {t.lower().replace(" ", "_") for t in ts if t}}
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("most", [64, 1])
def test_sourced_facts_are_the_facts(spark, most):
    quads = [(i % 23, f"S {i % 5}", "g", "is_a", f"o{i % 3}", "TFM"[i % 3] if i % 7 else None, f"src{i % 4}" if i % 6 else None) for i in range(90)]
    e = spark.createDataFrame([(100 - i, s, c, p, o, None, t, None, None, src, 0, 0, False, False) for i, (_, s, c, p, o, t, src) in enumerate(quads)], ENTRY)
    want = store.facts(e).select("id", *store.QUAD, F.when(F.col("truth_value") == "T", "T").alias("truth_value"), "source")
    got = store.sourced(e, most)
    assert collected(got) == collected(want)
    assert ("SortAggregate" in got._jdf.queryExecution().toString()) == (most == 1)


def test_facts_with_bridges_packs_the_pairs_of_a_hub(spark, tmp_path, monkeypatch):
    """What is written is runs and short repeats: far less than a byte a pair."""
    monkeypatch.setattr(bridges, "TASK_PAIRS", 100_000)
    e = spark.range(700).select((F.col("id") * 7919).alias("id"), F.lit("hub").alias("subject"), F.concat(F.lit("o"), "id").alias("object"))
    table = spark.range(901).select((F.col("id") * 104_729).alias("id"), F.lit("hub").alias("term_a"), F.lit(None).cast("string").alias("term_b"))
    bridges.facts_with_bridges(e, table).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.distinct().count() == got.count() == 700 * 901
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size < 0.25 * 700 * 901


def test_a_growing_store_frees_what_a_rule_shuffled(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(pulse, "free", freed.append)
    growing = pulse.Growing(kb(spark, [("a", "g", "is_a", "b")]))
    found = growing.view().select("subject", "context", F.lit("uses").alias("predicate"), "object", "truth_value", "needs_verification", "source", F.lit("x").alias("evidence"), F.lit(0).alias("rank"))
    assert growing.add(found, 1, 5) == 1 and freed == [spark]
