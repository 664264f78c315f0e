"""Queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.canonical import canonical_names
from rivulet.llm.components import synonym_groups
from rivulet.llm.dedup import facts, formatting_copies
from rivulet.llm.encoding import encode_corpus
from rivulet.llm.leakage import leaked_items
from rivulet.llm.sentences import sentences
from rivulet.llm.terms import term_frequencies
from rivulet.sql import norm_sql
from rivulet.tables import load

TRIPLE = ["subject", "predicate", "object"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_copies(load(spark, d, "entries"), "id", TRIPLE).filter("copy_id <> entry_id").select("entry_id", "copy_id")


def p1_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(load(spark, d, "entries"), "id", TRIPLE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return synonym_groups(load(spark, d, "synonyms"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(load(spark, d, "entries"), ["predicate", "subject"]).filter("mark is not null").select("field", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(load(spark, d, "entries"), ["predicate", "subject"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = canonical_names(load(spark, d, "entries"), "id", "predicate", load(spark, d, "predicate_map"), "original", "canonical")
    return found.select("entry_id", "canonical")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(load(spark, d, "documents"))


def p7_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Every hundred consecutive documents as one text, most of them far longer than a leaf: volume and ids."""
    docs = load(spark, d, "documents").select((F.col("doc_id") / 100).cast("bigint").alias("volume"), F.struct("doc_id", "text").alias("t"))
    texts = docs.groupBy("volume").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), "").alias("text"))  # at most 100 documents
    return encode_corpus(texts, "volume", "text").withColumnRenamed("doc_id", "volume")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(load(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_facts, p2_found, p4_found, p4_terms, p6_found, p7_ids, p7_volumes, p8_found, p8_items, p9_found)
    return {f.__name__: f for f in found}


def _members(c: str) -> str:
    return rf"list_sort(list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^\p{{L}}\p{{Nd}},]+', '', 'g'), ','), lambda x: x <> '')))"


_CLASSES = f"""
WITH m AS (SELECT id, {_members("subject")} AS s, {_members("predicate")} AS p, {_members("object")} AS o FROM entries
           WHERE id IS NOT NULL AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL),
c AS (SELECT min(id) OVER (PARTITION BY s, p, o) AS entry_id, id AS copy_id, count(*) OVER (PARTITION BY s, p, o) AS n_copies
      FROM m WHERE len(s) > 0 AND len(p) > 0 AND len(o) > 0)
"""

_TERMS = f"""
WITH v AS (SELECT 'predicate' AS field, id, {norm_sql("predicate")} AS t FROM entries
           UNION ALL SELECT 'subject', id, {norm_sql("subject")} FROM entries),
n AS (SELECT field, count(*) AS total FROM v WHERE t <> '' GROUP BY field),
w AS (SELECT field, id, unnest(string_split_regex(t, '[_,]+')) AS term FROM v WHERE t <> ''),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM w WHERE term <> '' GROUP BY field, term),
f AS (SELECT c.field, term, occurrences, records,
             CASE WHEN occurrences <= 2 THEN 'rare' WHEN records * 20 > total THEN 'common' END AS mark FROM c JOIN n ON c.field = n.field)
"""

_LEAKS = r"""
WITH i AS (SELECT item_id, text, lower(coalesce(lang, '')) = 'zh' AS zh FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM i WHERE NOT zh),
dw AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM d),
ip AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS piece FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM iw WHERE len(w) >= 12)),
dp AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS piece FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM dw WHERE len(w) >= 12)),
iz AS (SELECT item_id, unnest(regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'), '\p{Han}+')) AS r FROM i WHERE zh),
dz AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'), '\p{Han}+')) AS r FROM d),
izp AS (SELECT DISTINCT item_id, r[k : k + 19] AS piece FROM (SELECT item_id, r, unnest(range(1, length(r) - 18)) AS k FROM iz WHERE length(r) >= 20)),
dzp AS (SELECT DISTINCT doc_id, r[k : k + 19] AS piece FROM (SELECT doc_id, r, unnest(range(1, length(r) - 18)) AS k FROM dz WHERE length(r) >= 20)),
leaks AS (SELECT doc_id, item_id FROM dp JOIN ip USING (piece) UNION SELECT doc_id, item_id FROM dzp JOIN izp USING (piece))
"""


def oracle_sql() -> dict[str, str]:
    a, b = norm_sql("term"), norm_sql("synonym")
    return {
        "p1_found": _CLASSES + "SELECT entry_id, copy_id FROM c WHERE copy_id <> entry_id",
        "p1_facts": _CLASSES + "SELECT DISTINCT entry_id, n_copies FROM c",
        "p2_found": f"""
WITH RECURSIVE l AS (SELECT {a} AS x, {b} AS y FROM synonyms),
e AS (SELECT x, y FROM l WHERE x <> '' AND y <> '' UNION SELECT y, x FROM l WHERE x <> '' AND y <> ''),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS term, least(x, min(y)) AS group_term FROM r GROUP BY x""",
        "p4_found": _TERMS + "SELECT field, term, mark FROM f WHERE mark IS NOT NULL",
        "p4_terms": _TERMS + "SELECT field, term, occurrences, records, mark FROM f",
        "p8_found": _LEAKS + "SELECT doc_id, item_id FROM leaks",
        "p8_items": _LEAKS + "SELECT item_id, count(*) AS n_documents FROM leaks GROUP BY item_id",
    }
