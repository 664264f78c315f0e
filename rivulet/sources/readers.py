"""Readers: seed files, the two public dumps, article extracts and plain text; all give fact or chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import vocabulary as V
from rivulet.functions.parsing import chunk_text
from rivulet.functions.text import insert_norm, present
from rivulet.operators.derived import rows
from rivulet.operators.domains import classify, context_of

_ENTRY = "struct<subject:string,predicate:string,object:string,context:string,truth_value:string,source:string,generation:int,evidence_for:array<string>,evidence_against:array<string>>"
_SEED = f"topic string, default_context string, concepts array<struct<subject:string,context:string,definition:string>>, entries array<{_ENTRY}>"


def read_seed(spark: SparkSession, path: str, source: str = "seed", evidence: bool = True) -> DataFrame:
    """Facts of JSON seed files, either ``{default_context, concepts, entries}`` or a plain list of entries.

    Context falls back to the file's default, then 'general'; truth to T;
    evidence to ['seed:<file>'] (or none with ``evidence=False``).  Rows with
    an empty term are left out.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    doc = F.when(~is_list, F.from_json("value", _SEED))
    plain = F.when(is_list, F.from_json("value", f"array<{_ENTRY}>"))
    e = raw.select("file", doc["default_context"].alias("dc"), F.posexplode(F.coalesce(doc["entries"], plain, F.array().cast(f"array<{_ENTRY}>"))).alias("seq", "e"))
    none = F.array().cast("array<string>")
    out = e.select(
        "file", "seq",
        insert_norm(F.col("e.subject")).alias("subject"),
        F.coalesce("e.context", "dc", F.lit("general")).alias("context"),
        insert_norm(F.col("e.predicate")).alias("predicate"),
        insert_norm(F.col("e.object")).alias("object"),
        F.coalesce("e.truth_value", F.lit("T")).alias("truth_value"),
        F.coalesce("e.source", F.lit(source)).alias("source"),
        F.coalesce("e.generation", F.lit(0)).alias("generation"),
        F.coalesce("e.evidence_for", F.array(F.concat(F.lit("seed:"), "file")) if evidence else none).alias("evidence_for"),
        F.coalesce("e.evidence_against", none).alias("evidence_against"),
    )
    return out.filter(present("subject") & present("predicate") & present("object"))


def read_seed_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(subject, context, definition) of the concepts in JSON seed files."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", _SEED).alias("d"))
    return doc.select("d.default_context", F.explode("d.concepts").alias("c")).select("c.subject", F.coalesce("c.context", "default_context", F.lit("general")).alias("context"), "c.definition")


def with_context(facts: DataFrame, domains: V.Domains | None = None) -> DataFrame:
    """``facts`` with the context that classifying the subject gives."""
    labels = classify(facts.select(F.col("subject").alias("term")), domains).filter(F.size("domains") > 0).select(F.col("term").alias("subject"), context_of(F.col("domains")).alias("context"))
    return facts.join(labels, "subject", "left").withColumn("context", F.coalesce("context", F.lit("general")))


def read_conceptnet(spark: SparkSession, path: str, max_edges: int | None = 100_000, language: str = "en", min_weight: float = 1.0, domains: V.Domains | None = None) -> DataFrame:
    """Facts of a ConceptNet dump (tab-separated, also gzip).

    A line needs five columns, both terms of the language, a known relation and
    a weight (missing is 0, broken JSON drops the line) of ``min_weight`` or
    more.  ``max_edges`` accepted edges in file order, duplicates counted.
    """
    c = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).withColumn("c", c).filter(F.size("c") >= 5)
    mark = f"/c/{language}/"
    term = lambda i: F.split_part(F.split_part(F.get("c", F.lit(i)), F.lit(mark), F.lit(2)), F.lit("/"), F.lit(1))
    rel = rows(spark, sorted(V.CONCEPTNET_RELATIONS.items()), "relation string, predicate string")
    meta = F.from_json(F.get("c", F.lit(4)), "weight double, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    e = lines.filter(F.contains(F.get("c", F.lit(2)), F.lit(mark)) & F.contains(F.get("c", F.lit(3)), F.lit(mark)))
    e = e.select("line", F.get("c", F.lit(1)).alias("relation"), term(2).alias("s"), term(3).alias("o"), meta.alias("m")).join(rel, "relation")
    e = e.filter(F.col("m").isNotNull() & F.col("m._bad").isNull()).withColumn("weight", F.coalesce("m.weight", F.lit(0.0))).filter(F.col("weight") >= min_weight)
    if max_edges is not None:
        e = e.orderBy("line").limit(max_edges)
    f = e.select("line", insert_norm("s").alias("subject"), "predicate", insert_norm("o").alias("object"), F.lit("T").alias("truth_value"), F.lit("conceptnet").alias("source"), F.array(F.format_string("conceptnet:weight=%.1f", "weight")).alias("evidence_for"))
    return with_context(f.filter(present("subject") & present("object")), domains)


def read_wikidata(spark: SparkSession, path: str, max_entities: int | None = 50_000, language: str = "en", domains: V.Domains | None = None) -> DataFrame:
    """Facts of a Wikidata dump (one entity a line, also bzip2).

    Brackets, broken lines and entities without a label are skipped; per known
    property a claim's entity id, string, or text of the language is an object.
    """
    clean = F.rtrim(F.rtrim(F.trim("value")), F.lit(","))
    claim = "array<struct<mainsnak:struct<datavalue:struct<type:string,value:string>>>>"
    schema = f"id string, labels map<string,struct<value:string>>, claims map<string,{claim}>"
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).select("line", clean.alias("v")).filter(~F.col("v").isin("[", "]", ""))
    ent = lines.select("line", F.from_json("v", schema).alias("e")).select("line", F.element_at("e.labels", language)["value"].alias("label"), "e.claims").filter(present("label"))
    if max_entities is not None:
        ent = ent.orderBy("line").limit(max_entities)
    props = rows(spark, sorted(V.WIKIDATA_PROPERTIES.items()), "property string, predicate string")
    flat = ent.select("line", "label", F.explode("claims").alias("property", "cs")).join(props, "property")
    v = flat.select("line", "label", "property", "predicate", F.explode("cs.mainsnak.datavalue").alias("d"))
    value, kind = F.col("d.value"), F.col("d.type")
    obj = (
        F.when(kind == "wikibase-entityid", F.get_json_object(value, "$.id")).when(kind == "string", value)
        .when((kind == "monolingualtext") & (F.get_json_object(value, "$.language") == language), F.get_json_object(value, "$.text"))
    )
    f = v.select("line", insert_norm("label").alias("subject"), "predicate", insert_norm(obj).alias("object"), F.lit("T").alias("truth_value"), F.lit("wikidata").alias("source"), F.array(F.concat(F.lit("wikidata:"), "property")).alias("evidence_for"))
    return with_context(f.filter(present("subject") & present("object")), domains)


def article_chunks(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_size: int = 1500, overlap: int = 200, least: int = 0, most: int | None = None) -> DataFrame:
    """(id, chunk_no, chunk) of every text; chunks under ``least`` characters are skipped, ``most`` per text kept."""
    chunks = chunk_text(F.col(text_col), chunk_size, overlap)
    if most is not None:
        chunks = F.slice(chunks, 1, most)
    out = texts.select(F.col(id_col).alias("id"), F.posexplode(chunks).alias("chunk_no", "chunk"))
    return out.filter(F.length("chunk") >= least)


def read_textbook(spark: SparkSession, path: str, **options) -> DataFrame:
    """(id = file, chunk_no, chunk) of .txt, .md and .text files below a path; chunks under 50 characters are skipped."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,text}").text(path, wholetext=True)
    return article_chunks(t.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value"), "file", "value", least=50, **options)


def extracts(text: str = "value") -> Column:
    """array<struct<title, body>> of ``<doc … title="…">…</doc>`` extracts; a text without any is one article."""
    docs = F.regexp_extract_all(text, F.lit(r"(?s)(<doc\s[^>]*>.*?</doc>)"), F.lit(1))
    part = lambda d, pattern: F.regexp_extract(d, pattern, 1)
    many = F.transform(docs, lambda d: F.struct(part(d, r'title="([^"]*)"').alias("title"), F.trim(part(d, r"(?s)<doc\s[^>]*>(.*?)</doc>"), F.lit(" \n\t")).alias("body")))
    one = F.array(F.struct(F.lit("").alias("title"), F.trim(F.col(text), F.lit(" \n\t")).alias("body")))
    return F.when(F.size(docs) > 0, many).otherwise(one)


def extract_chunks(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100, first: int = 3000, most: int = 3) -> DataFrame:
    """(id, title, chunk_no, chunk) of article extracts: articles of ``least`` characters or more, their first
    ``first`` characters, at most ``most`` chunks each (limits of the extract reader itself; None lifts them)."""
    a = texts.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(extracts(text_col)).alias("a")).select("id", "a.title", "a.body").filter(F.length("body") >= least)
    body = F.left("body", F.lit(first)) if first is not None else F.col("body")
    chunks = chunk_text(body)
    return a.select("id", "title", F.posexplode(F.slice(chunks, 1, most) if most is not None else chunks).alias("chunk_no", "chunk"))


def section_chunks(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = 3, least: int = 100) -> DataFrame:
    """(id, section, chunk_no, chunk) of a file cut at '==' rules or three and more line ends: sections of ``least``
    characters or more, blanks aside; ``most`` chunks a section (the reader's own limits; None and 0 lift them)."""
    s = texts.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), r"\n={2,}\s*\n|\n{3,}")).alias("section", "body"))
    s = s.withColumn("body", F.trim("body", F.lit(" \n\t\r"))).filter(F.length("body") >= least)
    chunks = chunk_text(F.col("body"))
    return s.select("id", "section", F.posexplode(F.slice(chunks, 1, most) if most is not None else chunks).alias("chunk_no", "chunk"))
