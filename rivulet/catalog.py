"""Queries of the core library, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import oracle
from rivulet import vocabulary as V
from rivulet.functions.hashing import quad_hash
from rivulet.functions.parsing import pipe_triples, question_terms, sections, verdict
from rivulet.functions.text import insert_norm, is_atomic, lookup_norm, scope_norm
from rivulet.operators import aggregates, bridges, derived, displays, domains, fulltext, gates, graph, journal, lookups
from rivulet.operators.orphans import knowledge_base_orphans, orphans_by_month, star_orphans
from rivulet.operators.trees import closure, hierarchies
from rivulet.plans import pulse, query_engine, store
from rivulet.sources import readers, star
from rivulet.streaming import queue
from rivulet.tables import Work, free, load

QUAD = store.QUAD


def _kb(spark: SparkSession, d: str) -> DataFrame:
    return store.facts(load(spark, d, "entries"))


def _stored(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The store as a written table, for queries that read it several times; of its columns those that rules and lookups
    read, and ``more``."""
    stored = Work(spark, "store").put(_kb(spark, d).select("id", *QUAD, "truth_value", "source", "generation", *more))
    free(spark)
    return stored


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """The facts and which are true, for queries that read them once or a small share of them."""
    return store.judged(load(spark, d, "entries"))


def _taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """The ``_judged`` facts of the taxonomy predicates; of other rows only the predicate is normalised."""
    e = load(spark, d, "entries")
    return store.judged(e.filter(insert_norm("predicate").isin(V.TAXONOMY_LINKS)))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the store as a written table."""
    return Work(spark, "store").put(_kb(spark, d))


def _standing(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bridges").filter("deleted_at is null")


def p3_found(spark, d):
    return closure(load(spark, d, "hierarchy")).select("child", "ancestor")


def p3_depths(spark, d):
    return closure(load(spark, d, "hierarchy"))


def p3_hierarchies(spark, d):
    return hierarchies(load(spark, d, "hierarchy"))


def p5_found(spark, d):
    return knowledge_base_orphans(spark, d).select("table_name", "record_key", "ref_month", "reason")


def p5_by_month(spark, d):
    return orphans_by_month(knowledge_base_orphans(spark, d)).select("table_name", "ref_month", "reason", "kind", F.col("n").cast("bigint").alias("n"))


def p5_cascade(spark, d):
    """Orphans of the star schema, per table, month and level of the cascade."""
    found = star_orphans(spark, d)
    return found.groupBy("table_name", "via", "ref_month", "reason", "level").agg(F.count(F.lit(1)).alias("n"))


def normalize_terms(spark, d):
    return load(spark, d, "entries").select("id", insert_norm("subject").alias("inserted"), scope_norm("subject").alias("scoped"), lookup_norm("subject").alias("looked_up"))


def append_dedup(spark, d):
    """Rows of later generations that a store of generation 0 accepts, with their new ids."""
    e = load(spark, d, "entries")
    old = Work(spark, "store").put(store.facts(e.filter("generation = 0")))
    new = store.append(old, e.filter("generation > 0"))
    top = old.agg(F.max("id")).first()[0] or 0
    return store.number(new.select("input_id", *QUAD), ["input_id"], top + 1)


def star_triples(spark, d):
    return star.star_triples(spark, d)


def find_exact(spark, d):
    return lookups.find(_kb(spark, d), predicate="is_a", truth_value="T").select("id", *QUAD)


def search_like(spark, d):
    return lookups.search(_kb(spark, d), "tidal_b").select("id", "subject", "object", "truth_value", "generation")


def search_multi(spark, d):
    return lookups.search_multi(_kb(spark, d), ["tizepebo", "frozen spring"]).select("id", "subject", "object")


def all_true(spark, d):
    return lookups.all_entries(_kb(spark, d), "T").select("id", *QUAD)


def next_generation(spark, d):
    kb = _kb(spark, d)
    return kb.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("generation"))


def concept_lookup(spark, d):
    """The definitions of the subject with most facts, in all contexts."""
    return lookups.concept(upsert_concepts(spark, d), "groundwater_basin")


def about(spark, d):
    return lookups.about(_kb(spark, d), "groundwater basin", "chemistry").select("id", "context", "predicate", "object")


def reverse(spark, d):
    return lookups.reverse(_kb(spark, d), "tidal_basin").select("id", "subject", "context", "predicate")


def unresolved(spark, d):
    return lookups.unresolved(_kb(spark, d), 30).select("id", *QUAD)


def known_subjects(spark, d):
    return lookups.known_subjects(_kb(spark, d))


def ambiguous_subjects(spark, d):
    return lookups.ambiguous_subjects(_kb(spark, d))


def subject_display(spark, d):
    return lookups.subject_display(_stored(spark, d))


def raw_lookup(spark, d):
    return lookups.raw_lookup(_stored(spark, d), _standing(spark, d), "tizepebo")


def stats_source(spark, d):
    return aggregates.stats_by_source(_kb(spark, d))


def stats_grade_pivot(spark, d):
    return aggregates.stats_by_grade(_kb(spark, d))


def stats_dashboard(spark, d):
    return aggregates.dashboard(_stored(spark, d, "grade_level"))


def kb_report(spark, d):
    return aggregates.report(_kb(spark, d))


def kb_report_parts(spark, d):
    kb = Work(spark, "store").put(store.sourced(load(spark, d, "entries")))
    free(spark)
    lookup = derived.rows(spark, derived.predicate_lookup(), "original string, canonical string")
    hierarchy = derived.descendants(kb).agg(F.coalesce(F.sum("h"), F.lit(0)).alias("n"))
    # a row of centrality for every term of the degrees
    tables = {"centrality": aggregates.degrees(kb), "synonyms": derived.build_synonyms(kb), "domains": derived.domain_clusters(kb), "predicates": lookup}
    return aggregates.report_parts(kb, tables, counted={"hierarchy": hierarchy})


def pulse_merge(spark, d):
    return pulse.merge(_stored(spark, d), pulse.Settings()).select(*QUAD, "truth_value", "evidence")


def pulse_merge_all(spark, d):
    return pulse.merge(_stored(spark, d), pulse.Settings(cap=None)).select(*QUAD, "truth_value", "evidence")


def pulse_transitive(spark, d):
    return pulse.transitive(_stored(spark, d), pulse.Settings()).select(*QUAD, "truth_value", "evidence")


def transitive_blocked(spark, d):
    return pulse.blocked_chains(_stored(spark, d), pulse.Settings())


def pulse_cross_domain(spark, d):
    return pulse.cross_domain(_stored(spark, d), _standing(spark, d), pulse.Settings()).select(*QUAD, "truth_value", "evidence")


def cross_groups(spark, d):
    return pulse.shared_properties(_stored(spark, d), pulse.Settings())


def pulse_analogy(spark, d):
    return pulse.analogy(_judged(spark, d), pulse.Settings()).select(*QUAD, "truth_value", "evidence")


def profile_pairs(spark, d):
    s = pulse.similar_profiles(_judged(spark, d), pulse.Settings())
    return s.select("context", F.array_join("p1", ",").alias("p1"), F.array_join("p2", ",").alias("p2"), F.round("sim", 6).alias("sim"))


def profile_classes(spark, d):
    return pulse.profiles(_kb(spark, d), pulse.Settings()).select("context", F.array_join("profile", ",").alias("profile"), "n", "first_subject")


def pulse_profile_size(spark, d):
    return pulse.profile_sizes(_kb(spark, d))


def pulse_transitive_variant(spark, d):
    s = pulse.Settings(ignore_context=True, truth_by_confidence=True)
    return pulse.transitive(_stored(spark, d), s).select(*QUAD, "truth_value")


def pulse_cross_variant(spark, d):
    s = pulse.Settings(cross_skip=("profile_size",), group_max=8)
    return pulse.cross_domain(_stored(spark, d), _standing(spark, d), s).select(*QUAD, "truth_value", "evidence")


def profile_pairs_variant(spark, d):
    s = pulse.similar_profiles(_judged(spark, d), pulse.Settings(similarity=0.3, min_profile=3, min_shared=2))
    return s.select("context", F.array_join("p1", ",").alias("p1"), F.array_join("p2", ",").alias("p2"), F.round("sim", 6).alias("sim"))


def pulse_run(spark, d):
    """Facts by generation and source after two pulses with verification."""
    s = pulse.run(_whole(spark, d), _standing(spark, d), cycles=2)
    return s.groupBy("source", "truth_value").agg(F.count(F.lit(1)).alias("n"))


def verify_offline(spark, d):
    return store.verify_offline(_kb(spark, d), 500, V.SAFE_CURRICULUM)


def update_truth(spark, d):
    """All facts after the offline verdicts were written back."""
    kb = _whole(spark, d)
    v = store.verify_offline(kb, 500, V.SAFE_PRODUCTION).filter("truth_value = 'T' and verified").select("id", F.col("truth_value").alias("truth"), F.lit("auto").alias("evidence"))
    out = store.update_truth(kb, v)
    return out.select("id", "truth_value", "verified", "needs_verification", F.size("evidence_for").alias("n_for"), F.size("evidence_against").alias("n_against"))


def upsert_concepts(spark, d):
    """The latest definition of each subject and context, from the documents."""
    docs = load(spark, d, "documents").filter("subject is not null and context is not null and text is not null")
    c = docs.select("subject", "context", F.col("text").alias("definition"), "source", F.col("doc_id").alias("seq"))
    none = c.filter("false").drop("seq")
    return store.upsert_concepts(none, c)


def _gate_pairs(spark, d):
    p = _kb(spark, d).select(F.col("predicate").alias("inherited")).distinct()
    return p.select("inherited", F.explode(F.array(*[F.lit(x) for x in oracle.GATE_LINKS])).alias("link"))


def gate_verdicts(spark, d):
    r = gates.Rules()
    return _gate_pairs(spark, d).select("link", "inherited", r.verdict(F.col("link"), F.col("inherited")).alias("verdict"))


def chain_confidence(spark, d):
    r = gates.Rules()
    return _gate_pairs(spark, d).select("link", "inherited", r.confidence(F.col("link"), F.col("inherited")).alias("confidence"))


def rule_suggest(spark, d):
    """Outcomes: every fact judged true or false, paired with the predicate class of its context."""
    o = _kb(spark, d).filter("truth_value in ('T', 'F')").select(F.col("context").alias("link"), F.col("predicate").alias("inherited"), (F.col("truth_value") == "T").alias("approved"))
    return gates.suggest_rules(gates.pair_stats(o))


def learner_report(spark, d):
    o = _kb(spark, d).filter("truth_value in ('T', 'F')").select(F.col("context").alias("link"), F.col("predicate").alias("inherited"), (F.col("truth_value") == "T").alias("approved"))
    return displays.learner_report(gates.pair_stats(o))


def show_unresolved(spark, d):
    return displays.unresolved_shown(_kb(spark, d))


def show_confusions(spark, d):
    return displays.confusions_shown(confusions(spark, d))


def show_bridges(spark, d):
    return displays.bridges_shown(_standing(spark, d))


def show_candidates(spark, d):
    return displays.candidates_shown(_stored(spark, d))


def rule_learned(spark, d):
    """The gate's verdicts after learning from the outcomes of ``rule_suggest``."""
    r = gates.apply_rules(gates.Rules(), Work(spark, "learned").put(rule_suggest(spark, d)), unblock=True)
    return _gate_pairs(spark, d).select("link", "inherited", r.verdict(F.col("link"), F.col("inherited")).alias("verdict"))


def predicate_normalize(spark, d):
    return derived.normalize_predicates(_kb(spark, d)).select("id", "subject", "predicate", "object")


def hierarchy_closure(spark, d):
    return derived.build_hierarchy(_taxonomy(spark, d)).select("child", "ancestor", "depth")


def centrality(spark, d):
    return aggregates.centrality_of(_judged(spark, d), derived.descendants(_taxonomy(spark, d)))


def synonyms(spark, d):
    return derived.build_synonyms(_stored(spark, d))


def domain_cluster(spark, d):
    return derived.domain_clusters(_stored(spark, d))


def domain_cluster_like(spark, d):
    return derived.domain_clusters(_kb(spark, d), literal_like=True)


def dedup_triples(spark, d):
    return derived.deduplicate(_kb(spark, d)).select("id", "subject", "predicate", "object")


def integrity(spark, d):
    kb = _stored(spark, d)
    return derived.integrity(kb, load(spark, d, "hierarchy").select(insert_norm("child").alias("child")).filter("child <> ''"))


def neighbors_d2(spark, d):
    return graph.neighbors(_stored(spark, d), "tizepebo", 2, "earth_science")


def neighbors_out(spark, d):
    return graph.neighbors(_stored(spark, d), "tizepebo", 2, outgoing_only=True, atomic_only=True)


def graph_size(spark, d):
    return graph.graph_size(graph.neighbors(_stored(spark, d), "futadala", 2, atomic_only=True))


def path_bounded(spark, d):
    return graph.find_path(_stored(spark, d), "tizepebo", "kekegete")


def path_outgoing(spark, d):
    return graph.find_path(_stored(spark, d), "tizepebo", "futadala", outgoing_only=True)


def classify_domains(spark, d):
    terms = _kb(spark, d).select(F.explode(F.array("subject", "object")).alias("term"))
    return domains.classify(terms).select("term", F.array_join("domains", ",").alias("domains"), domains.context_of(F.col("domains")).alias("context"))


def classify_learned(spark, d):
    """Domains of all terms with those learned from the clustered facts."""
    kb = _stored(spark, d)
    learned = Work(spark, "learned").put(domains.learned_labels(kb, derived.domain_clusters(kb)))
    found = domains.classify(kb.select(F.explode(F.array("subject", "object")).alias("term")), learned=learned)
    return found.select("term", F.array_join("domains", ",").alias("domains"))


def compat_score(spark, d):
    f = domains.with_domains(_stored(spark, d))
    return f.select("id", domains.compatibility(F.col("s_domains"), F.col("o_domains")).alias("score"))


def compatible_pairs(spark, d):
    """Of every fact whether its two terms are compatible, and whether they may be called analogous."""
    f = domains.with_domains(_stored(spark, d))
    s, o = F.col("s_domains"), F.col("o_domains")
    return f.select("id", domains.compatible(s, o).alias("compatible"), domains.analogy_gate(s, o).alias("analogous"))


def clean_facts(spark, d):
    return domains.clean(_stored(spark, d)).select("id", *QUAD)


def domain_matrix(spark, d):
    return domains.dictionary(spark)


def nonsense_filter(spark, d):
    return domains.nonsense(_stored(spark, d)).select("id", "reason")


def predicate_profile(spark, d):
    return domains.predicate_profile(_stored(spark, d))


def type_gate(spark, d):
    kb = _stored(spark, d)
    return domains.type_gate(kb, domains.predicate_profile(kb)).select("id", "score", "gate", "confidence")


def scope_blocked(spark, d):
    kb = _stored(spark, d, "needs_verification")
    _, rejected = domains.gate(kb, "transitive", domains.predicate_profile(kb))
    return domains.blocked_by_reason(rejected)


def domain_analysis(spark, d):
    return domains.analyze(_stored(spark, d))


def bridge_add_dedup(spark, d):
    """Bridges with odd ids added to those with even ids."""
    b = load(spark, d, "bridges")
    return bridges.add_bridges(b.filter("id % 2 = 0"), b.filter("id % 2 = 1")).drop("examples")


def bridge_add_undirected(spark, d):
    b = load(spark, d, "bridges")
    return bridges.add_bridges(b.filter("id % 2 = 0"), b.filter("id % 2 = 1"), undirected=True).drop("examples")


def bridge_find(spark, d):
    return bridges.find_bridges(load(spark, d, "bridges"), "tizepebo").select("id", "term_a", "term_b", "strength")


def bridge_between(spark, d):
    return bridges.bridges_between(load(spark, d, "bridges"), "chemistry", "physics").select("id", "term_a", "term_b")


def bridge_stats(spark, d):
    return bridges.bridge_stats(load(spark, d, "bridges"))


def bridge_examples(spark, d):
    return bridges.examples_of(load(spark, d, "bridges"), load(spark, d, "bridge_examples"))


def bridge_facts(spark, d):
    return bridges.facts_with_bridges(_kb(spark, d), _standing(spark, d))


def bridge_discover_shared(spark, d):
    return bridges.shared_mechanisms(_stored(spark, d))


def bridge_discover_stated(spark, d):
    return bridges.bridge_predicates(_kb(spark, d))


def bridge_stated_by(spark, d):
    """Stated bridges by predicates of this store's own."""
    return bridges.bridge_predicates(_kb(spark, d), oracle.STATED_BY)


def bridge_shared_members(spark, d):
    return bridges.mechanism_members(_stored(spark, d))


def bridge_discover_structural(spark, d):
    return bridges.structural_patterns(_stored(spark, d))


def bridge_structural_words(spark, d):
    """Structural patterns by words of this store's own."""
    return bridges.structural_patterns(_stored(spark, d), words=oracle.STRUCTURAL_WORDS)


def bridge_structural_members(spark, d):
    m = bridges.structural_members(_stored(spark, d), words=oracle.STRUCTURAL_WORDS)
    return m.select("subject", F.array_join("domains", ",").alias("domains"), F.array_join("words", ",").alias("words"))


def bridge_potential(spark, d):
    return bridges.potential_bridges(_stored(spark, d))


def bridge_relevant(spark, d):
    terms = _kb(spark, d).select(F.explode(F.array("subject", "object")).alias("term")).filter(is_atomic("term"))
    return bridges.relevant_bridges(load(spark, d, "bridges"), terms).select("id")


def bridge_pairs(spark, d):
    kb = _stored(spark, d)
    found = pulse.cross_domain(kb, _standing(spark, d), pulse.Settings(cap=oracle.PAIRS))
    return bridges.cross_pattern_candidates(found)


def fts_tokens(spark, d):
    return fulltext.build_index(_kb(spark, d), stemmed=False, columns=["subject", "predicate", "object"])


def fts_index(spark, d):
    i = fulltext.build_index(_kb(spark, d))
    return i.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def fts_search(spark, d):
    kb = _stored(spark, d)
    syn = derived.build_synonyms(kb).select("term", "synonym")
    return fulltext.search_index(kb, fulltext.build_index(kb), ["tidal_basin", "slow"], syn).select("id", "subject", "object")


def fts_phrase(spark, d):
    kb = _stored(spark, d)
    return fulltext.search_index(kb, fulltext.build_index(kb, False, ["subject", "object"]), ["tidal basin"], stemmed=False).select("id", "subject", "object")


def question_answer(spark, d):
    return query_engine.answer(_stored(spark, d), _standing(spark, d), "How does tizepebo relate to futadala?")


def _texts(spark, d):
    return load(spark, d, "documents").select("doc_id", "text")


def question_terms_q(spark, d):
    return _texts(spark, d).select("doc_id", F.posexplode(question_terms(F.col("text"))).alias("pos", "term"))


def reply_triples(spark, d):
    return pipe_triples(_texts(spark, d), "doc_id", "text").select(F.col("id").alias("doc_id"), "line_no", "subject", "predicate", "object", "truth_value")


def reply_verdicts(spark, d):
    v, r = verdict(F.col("text"))
    return _texts(spark, d).filter("text like '%VERDICT%'").select("doc_id", v.alias("verdict"), r.alias("reason"))


def reply_sections(spark, d):
    return _texts(spark, d).filter("text is not null").select("doc_id", sections(F.col("text")).alias("s")).select("doc_id", "s.facts", "s.confused", "s.reasoning")


def chunk_text(spark, d):
    return readers.article_chunks(_texts(spark, d), chunk_size=600, overlap=80)


def wiki_extracts(spark, d):
    return readers.extract_chunks(_texts(spark, d), first=None, most=None)


def wiki_sections(spark, d):
    return readers.section_chunks(_texts(spark, d), most=None)


def _written(spark, df):
    """A table of texts (part, value) as files, one row each, below the shared folder."""
    path = Work(spark, "files").path()
    df.repartition("part").write.partitionBy("part").text(path)
    return path


def seed_read(spark, d):
    """The entries written as seed files of 5,000 each and read back."""
    e = load(spark, d, "entries").select((F.col("id") / 5000).cast("bigint").alias("part"), F.struct("subject", "predicate", "object", "context", "truth_value", "source", "generation", "evidence_for", "evidence_against").alias("e"))
    docs = e.groupBy("part").agg(F.to_json(F.struct(F.lit("water").alias("topic"), F.collect_list("e").alias("entries"))).alias("value"))  # at most 5,000 entries
    path = _written(spark, docs)
    return readers.read_seed(spark, f"{path}/part=*").select(*QUAD, "truth_value", "source", "generation")


def conceptnet_read(spark, d):
    """The entries written as an edge dump and read back; the weight of an edge is its generation."""
    p, mark = F.lower("predicate"), F.lit("/c/en/")
    names = derived.rows(spark, sorted((v, k) for k, v in V.CONCEPTNET_RELATIONS.items()), "name string, relation string")
    e = load(spark, d, "entries").join(names, p == F.col("name"), "left")
    meta = F.to_json(F.struct(F.col("generation").cast("double").alias("weight")))
    line = F.concat_ws("\t", F.lit("/a/x"), F.coalesce("relation", F.lit("/r/Other")), F.concat(mark, F.coalesce(insert_norm("subject"), F.lit("")), F.lit("/n")), F.concat(mark, F.coalesce(insert_norm("object"), F.lit(""))), meta)
    path = Work(spark, "files").path()
    e.select(line.alias("value")).write.text(path, compression="gzip")
    return readers.read_conceptnet(spark, path, max_edges=None).select(*QUAD)


def wikidata_read(spark, d):
    """The entries written as an entity dump, one claim an entity, and read back."""
    names = derived.rows(spark, sorted((v, k) for k, v in V.WIKIDATA_PROPERTIES.items()), "name string, property string")
    e = load(spark, d, "entries").join(names, F.lower("predicate") == F.col("name"), "left")
    snak = F.struct(F.struct(F.struct(F.lit("string").alias("type"), F.col("object").alias("value")).alias("datavalue")).alias("mainsnak"))
    entity = F.struct(F.concat(F.lit("Q"), "id").alias("id"), F.create_map(F.lit("en"), F.struct(F.col("subject").alias("value"))).alias("labels"), F.create_map(F.coalesce("property", F.lit("P0")), F.array(snak)).alias("claims"))
    path = Work(spark, "files").path()
    e.select(F.concat(F.to_json(entity), F.lit(",")).alias("value")).write.text(path, compression="bzip2")
    return readers.read_wikidata(spark, path, max_entities=None).select(*QUAD)


def textbook_read(spark, d):
    """The documents written as books of 50 texts and read back in chunks; how often each chunk comes out."""
    t = _texts(spark, d).filter("text is not null").select((F.col("doc_id") / 50).cast("bigint").alias("part"), F.struct("doc_id", "text").alias("t"))
    books = t.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), "\n\n").alias("value"))  # at most 50 texts
    path = _written(spark, books)
    return readers.read_textbook(spark, f"{path}/part=*").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def queue_order(spark, d):
    """Events as tasks: kind, payload and value as priority."""
    e = load(spark, d, "events")
    return queue.queue_order(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("task_type"), F.col("props").alias("payload"), F.floor(F.coalesce("value", F.lit(0.0)) % 10).cast("int").alias("priority")))


def queue_next(spark, d):
    e = load(spark, d, "events")
    return queue.next_tasks(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("task_type"), F.col("props").alias("payload"), F.floor(F.coalesce("value", F.lit(0.0)) % 10).cast("int").alias("priority")), 20)


def log_recent(spark, d):
    """Events as a log."""
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.lit(0).alias("grade_level"), F.col("props").alias("message"))
    return journal.recent(e, 50)


def confusions(spark, d):
    """False facts as confusions of subject and object, added to those of generation 0."""
    f = _kb(spark, d).filter("truth_value = 'F'").select("id", "subject", F.col("object").alias("confused_with"), F.col("predicate").alias("reason"), F.col("grade_level").alias("grade"), "generation")
    return journal.add_confusions(f.filter("generation = 0"), f.filter("generation > 0"))


def fnv1a(spark, d):
    return _kb(spark, d).select("id", quad_hash().alias("quad_hash"))


_QUERIES = [
    p3_found, p3_depths, p3_hierarchies, p5_found, p5_by_month, p5_cascade, all_true, next_generation, concept_lookup, kb_report_parts,
    learner_report, show_unresolved, show_confusions, show_bridges, show_candidates, cross_groups, classify_learned, rule_learned, path_outgoing, compatible_pairs, clean_facts, bridge_stated_by, bridge_shared_members, bridge_structural_words, bridge_structural_members,
    seed_read, conceptnet_read, wikidata_read, textbook_read,
    normalize_terms, append_dedup, star_triples, find_exact, search_like, search_multi, about, reverse, unresolved, known_subjects,
    ambiguous_subjects, subject_display, raw_lookup, stats_source, stats_grade_pivot, stats_dashboard, kb_report,
    pulse_merge, pulse_merge_all, pulse_transitive, transitive_blocked, pulse_cross_domain, pulse_analogy, profile_pairs, profile_classes, pulse_run,
    pulse_profile_size, pulse_transitive_variant, pulse_cross_variant, profile_pairs_variant,
    verify_offline, update_truth, upsert_concepts, gate_verdicts, chain_confidence, rule_suggest, predicate_normalize, hierarchy_closure, centrality,
    synonyms, domain_cluster, domain_cluster_like, dedup_triples, integrity, neighbors_d2, neighbors_out, graph_size, path_bounded,
    classify_domains, compat_score, domain_matrix, nonsense_filter, predicate_profile, type_gate, scope_blocked, domain_analysis,
    bridge_add_dedup, bridge_add_undirected, bridge_find, bridge_between, bridge_stats, bridge_examples, bridge_facts, bridge_discover_shared,
    bridge_discover_stated, bridge_discover_structural, bridge_potential, bridge_relevant, bridge_pairs, fts_tokens, fts_index, fts_search, fts_phrase,
    question_answer, question_terms_q, reply_triples, reply_verdicts, reply_sections, chunk_text, wiki_extracts, wiki_sections,
    queue_order, queue_next, log_recent, confusions, fnv1a,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__.removesuffix("_q"): q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.queries()
