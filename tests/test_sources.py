import gzip
import json

from pyspark.sql import functions as F

from rivulet import catalog
from rivulet.functions.parsing import bridge_verdict, chunk_text, payload, pipe_triples, question_terms, sections, verdict
from rivulet.sources import readers
from rivulet.streaming import queue

from .conftest import collected


def test_seed_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"default_context": "physics", "concepts": [{"subject": "x", "definition": "d"}], "entries": [{"subject": "A b", "predicate": "is", "object": "c"}, {"subject": "", "predicate": "p", "object": "o"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"subject": "q", "predicate": "p", "object": "o", "truth_value": "M", "evidence_for": ["e"]}]))
    got = collected(readers.read_seed(spark, str(tmp_path)).select("subject", "context", "truth_value", "evidence_for"))
    assert got == [("a_b", "physics", "T", ["seed:a.json"]), ("q", "general", "M", ["e"])]
    assert collected(readers.read_seed_concepts(spark, str(tmp_path / "a.json"))) == [("x", "physics", "d")]


def test_conceptnet(spark, tmp_path):
    edge = lambda r, s, o, m: "\t".join(["/a", r, s, o, m])
    lines = [
        edge("/r/IsA", "/c/en/dog/n", "/c/en/animal", '{"weight": 2.0}'), edge("/r/IsA", "/c/de/hund", "/c/en/animal", '{"weight": 2.0}'), edge("/r/Odd", "/c/en/a", "/c/en/b", '{"weight": 2.0}'),
        edge("/r/IsA", "/c/en/cat", "/c/en/animal", '{"weight": 0.5}'), edge("/r/IsA", "/c/en/cat", "/c/en/animal", "{}"), edge("/r/IsA", "/c/en/cat", "/c/en/animal", "{bad"), "too\tshort",
        edge("/r/UsedFor", "/c/en/pump", "/c/en/water_flow", '{"weight": 1.0}'),
    ]
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("\n".join(lines))
    got = collected(readers.read_conceptnet(spark, str(tmp_path / "c.tsv.gz")).select("subject", "predicate", "object", "context", F.col("evidence_for")[0]))
    assert got == [("dog", "is_a", "animal", "biology", "conceptnet:weight=2.0"), ("pump", "used_for", "water_flow", "engineering", "conceptnet:weight=1.0")]
    assert readers.read_conceptnet(spark, str(tmp_path / "c.tsv.gz"), max_edges=1).count() == 1


def test_wikidata(spark, tmp_path):
    snak = lambda t, v: {"mainsnak": {"datavalue": {"type": t, "value": v}}}
    ent = {"id": "Q1", "labels": {"en": {"value": "Big Rain"}}, "claims": {"P31": [snak("wikibase-entityid", {"id": "Q7"})], "P1542": [snak("string", "flood")], "P37": [snak("monolingualtext", {"language": "en", "text": "English"}), snak("monolingualtext", {"language": "fr", "text": "non"})], "P9999": [snak("string", "x")], "P17": [snak("time", {"t": 1})]}}
    (tmp_path / "w.json").write_text("[\n" + json.dumps(ent) + ",\n{broken,\n" + json.dumps({"id": "Q2", "labels": {"de": {"value": "x"}}, "claims": {}}) + "\n]")
    got = collected(readers.read_wikidata(spark, str(tmp_path / "w.json")).select("subject", "predicate", "object"))
    assert got == [("big_rain", "causes", "flood"), ("big_rain", "is_a", "q7"), ("big_rain", "official_language", "english")]


def chunks(text, size, overlap):
    """The chunker's rule as a plain loop."""
    import re

    out, cur = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if cur and len(cur) + len(p) > size:
            out.append(cur.strip())
            cur = cur[-overlap:] if overlap and len(cur) > overlap else ""
        cur += p + "\n\n"
    return out + ([cur.strip()] if cur.strip() else [])


def test_chunks(spark):
    texts = ["", None, "one", "a" * 40 + "\n\n" + "b" * 40 + "\n\nccc\n \nddd", "x" * 200, "\n\n".join("p" * (i % 17 + 1) for i in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for size, overlap in ((50, 10), (30, 0), (100, 40)):
        got = {r["doc_id"]: r["c"] for r in df.select("doc_id", chunk_text(F.col("text"), size, overlap).alias("c")).collect()}
        assert got == {i: chunks(t or "", size, overlap) for i, t in enumerate(texts)}


def test_extracts(spark):
    t = '<doc id="1" title="A">\n' + "x" * 120 + "\n</doc>\n" + '<doc id="2" title="B">short</doc>'
    df = spark.createDataFrame([(1, t), (2, "y" * 150), (3, None), (4, "")], "doc_id long, text string")
    assert [(r["id"], r["title"], len(r["chunk"])) for r in readers.extract_chunks(df).orderBy("id").collect()] == [(1, "A", 120), (2, "", 150)]
    s = spark.createDataFrame([(1, "a\n==\nb\n\n\nc")], "doc_id long, text string")
    assert [r["chunk"] for r in readers.section_chunks(s, least=0).orderBy("section").collect()] == ["a", "b", "c"]
    assert readers.section_chunks(s).count() == 0


def test_wiki_sections_keeps_every_chunk(spark, tmp_path):
    paras = [c * 1400 for c in "abcdef"]
    spark.createDataFrame([(1, "\n\n".join(paras) + "\n==\nz\n==\n" + "z" * 100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.wiki_sections(spark, str(tmp_path)).orderBy("section", "chunk_no").collect()
    assert [(r["section"], r["chunk_no"], r["chunk"][-1]) for r in got] == [(0, i, c) for i, c in enumerate("abcdef")] + [(2, 0, "z")]


def test_replies(spark):
    df = spark.createDataFrame([(1, "1. Water | Is-A | fluid\n- a|b\n* x | y | z | m\nVERDICT: **False**\nREASON: no way"), (2, None), (3, "")], "id long, text string")
    assert [tuple(r)[2:] for r in pipe_triples(df, "id", "text").orderBy("line_no").collect()] == [("water", "is_a", "fluid", "T"), ("x", "y", "z", "M")]
    v, r = verdict(F.col("text"))
    assert [tuple(x) for x in df.orderBy("id").select(v, r).collect()] == [("F", "no way"), ("M", ""), ("M", "")]
    q = spark.createDataFrame([("What's the water's use, and why?",), (None,)], "q string").select(question_terms(F.col("q")).alias("t")).collect()
    assert [x["t"] for x in q] == [["what", "water", "use,"], []]
    s = spark.createDataFrame([("REASONING: because\nFACTS:\n- a | b | c\nCONFUSED:\nx",)], "t string").select(sections(F.col("t")).alias("s")).first()["s"]
    assert (s["reasoning"], s["facts"], s["confused"]) == ("because", "- a | b | c", "x")
    b = spark.createDataFrame([("MEANINGFUL: yes\nTYPE: Scale\nSTRENGTH: 0.8\nREASON: r\nTEACHING: t",), ("",)], "t string").select(bridge_verdict(F.col("t")).alias("b")).collect()
    assert (b[0]["b"]["meaningful"], b[0]["b"]["bridge_type"], b[0]["b"]["strength"]) == (True, "scale", 0.8)
    assert (b[1]["b"]["meaningful"], b[1]["b"]["bridge_type"], b[1]["b"]["strength"]) == (False, "emergent", 0.5)
    p = spark.createDataFrame([('{"text": "q"}',), ("plain",), (None,)], "p string").select(payload(F.col("p"))).collect()
    assert [x[0] for x in p] == ["q", "plain", None]


def test_queue_stream(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    rows = [{"id": 1, "task_type": "research", "payload": "x", "priority": 1}, {"id": 2, "task_type": "verify", "payload": '{"text": "y"}'}, {"id": 3, "task_type": None, "payload": None, "priority": 9}]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    queue.run_queue(spark, str(src), str(out), str(cp))
    queue.run_queue(spark, str(src), str(out), str(cp))  # nothing is handled twice
    got = {r["id"]: (r["status"], r["batch"]) for r in queue.outcomes(spark, str(out)).collect()}
    first = got[1][1]
    assert got == {1: ("done", first), 2: ("pending", first + 1), 3: ("done", first)}  # what is pending is taken up again
    (src / "b.json").write_text(json.dumps({"id": 4, "task_type": "other", "payload": "z"}))
    queue.run_queue(spark, str(src), str(out), str(cp))
    got = {r["id"]: (r["status"], r["batch"]) for r in queue.outcomes(spark, str(out)).collect()}
    assert got[4][0] == "done" and got[2] == ("pending", got[4][1]) and got[1] == ("done", first)
    tasks = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "x", None), (3, "a", "x", 7)], queue.TASK)
    assert [r["id"] for r in queue.next_tasks(tasks, 2).collect()] == [3, 1]


class Librarian:
    """A model for tests: one fact for every text it is shown, and a verdict."""

    def ask(self, prompt):
        if prompt.startswith("Is this"):
            return "VERDICT: F\nREASON: read otherwise"
        if "JSON object" in prompt:
            return '```json\n{"subjects": ["dam"], "keywords": ["river"]}\n```'
        if prompt.startswith("Answer the question"):
            return "It does [1]."
        if prompt.startswith("Answer in three"):
            return "REASONING: so\nFACTS:\n- dam | stops | flood | M\nCONFUSED:\n- weir | dam | both hold water\n- broken"
        word = prompt.split()[-1].strip(".").lower()
        return f"1. {word} | is_a | thing | F\nno fact here"


def test_ingestion(spark, tmp_path):
    from rivulet.plans import ingestion, store

    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "water_book.txt").write_text("All about rivers, their sources, their mouths and their banks: river.\n\n" + "x " * 20)
    (tmp_path / "short.md").write_text("too short")
    (tmp_path / "other.csv").write_text("x" * 100)
    book = ingestion.textbook_facts(spark, str(tmp_path), Librarian(), 3)
    got = [(r["predicate"], r["object"], r["truth_value"], r["evidence_for"], r["source"], r["grade_level"]) for r in book.collect()]
    assert got == [("is_a", "thing", "T", ["textbook: water_book.txt, chunk 1"], "textbook:water_book.txt", 3)]
    texts = spark.createDataFrame([(1, f'<doc id="1" title="Tides">{"y " * 60}tide</doc>'), (2, "short"), (3, None)], "doc_id long, text string")
    articles = ingestion.article_facts(texts, Librarian()).collect()
    assert [(r["subject"], r["evidence_for"], r["source"]) for r in articles] == [("tide", ["wikipedia: Tides"], "wikipedia")]
    plain = spark.createDataFrame([(1, "a" * 120 + " lake\n==\nno")], "doc_id long, text string")
    assert [(r["subject"], r["evidence_for"]) for r in ingestion.section_facts(plain, Librarian()).collect()] == [("lake", ["wikipedia"])]
    topics = ingestion.topic_facts(spark, ["the moon", "moon"], Librarian()).collect()
    assert {(r["subject"], r["context"], r["truth_value"], r["source"]) for r in topics} == {("moon", "general", "F", "llm:seed"), ("moon", "physics", "F", "llm:seed")}
    empty = store.facts(book.filter("false"))
    grown, log = ingestion.ingest(empty, book, "textbook", str(tmp_path))
    assert grown.count() == 1 and log.first()["facts_added"] == 1
    again, log = ingestion.ingest(grown, book, "textbook", str(tmp_path))
    assert again.count() == 1 and log.first()["facts_added"] == 0


def test_agent_works_tasks_off(spark, tmp_path):
    from rivulet.plans import ingestion, store

    known = spark.createDataFrame([(7, "sea", "general", "is_a", "dry", "T")], "id long, subject string, context string, predicate string, object string, truth_value string")
    kb = store.facts(ingestion.as_entries(known, F.lit("s"), F.lit("e")))
    rows = [
        {"id": 1, "task_type": "research", "payload": '{"topic": "rain"}', "priority": 1}, {"id": 2, "task_type": "question", "payload": "why?", "priority": 9}, {"id": 3, "task_type": "decompose", "payload": "See the pond."},
        {"id": 4, "task_type": "verify", "payload": '{"entry_id": 7}'}, {"id": 5, "task_type": "dance", "payload": "x"}, {"id": 6, "task_type": "verify", "payload": "99"},
    ]
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    handler = queue.agent_handler(kb, Librarian(), f"{tmp_path}/facts", f"{tmp_path}/verdicts")
    queue.run_queue(spark, str(src), out, str(tmp_path / "cp"), handler)
    got = {r["id"]: r["result"] for r in queue.outcomes(spark, out).collect()}
    assert got == {1: "added 1 facts", 2: "added 1 facts", 3: "added 1 facts", 4: "verdict: F", 5: "unknown task type: dance", 6: "no answer"}
    facts = {(r["subject"], r["truth_value"], r["source"], r["evidence_for"][0]) for r in spark.read.parquet(f"{tmp_path}/facts").collect()}
    assert facts == {("rain", "T", "agent:research", "agent research: rain"), ("dam", "M", "agent:question", "agent Q&A: why?"), ("pond", "T", "agent:decompose", "agent decomposition")}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/verdicts").collect()] == [(7, "F", "read otherwise")]


def test_question_with_a_model(spark):
    from rivulet.plans import query_engine

    assert query_engine.parse_terms(spark, "Does the dam hold?", Librarian()) == ["dam", "river"]
    assert query_engine.parse_terms(spark, "Does the dam hold?") == ["dam", "hold"]
    facts = spark.createDataFrame([("hit", "dam", "g", "stops", "flood")], "section string, subject string, context string, predicate string, object string")
    assert query_engine.synthesize(facts, "q", Librarian()) == "It does [1]." and query_engine.synthesize(facts, "q", None) == "" and query_engine.synthesize(facts.filter("false"), "q", Librarian()) == ""
    assert query_engine.query_context(spark, ["nothing", "moon"]) == "physics" and query_engine.query_context(spark, ["nothing"]) is None
