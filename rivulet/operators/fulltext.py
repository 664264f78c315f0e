"""Full-text index over true facts: tokens with positions, phrase search with synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.porter import stem_column
from rivulet.operators.lookups import search_multi
from rivulet.tables import Work

#: Accented letters of the Latin script and their plain forms.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
COLUMNS = ["subject", "context", "predicate", "object", "source"]


def tokens_of(c: Column) -> Column:
    """Words of a column: '_' is a blank, lower case, accents of the Latin script folded."""
    folded = F.translate(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def build_index(store: DataFrame, stemmed: bool = True, columns: list[str] = COLUMNS) -> DataFrame:
    """(token, entry_id, col, pos): every word of the indexed columns of true facts with its position."""
    t = store.filter("truth_value = 'T'")
    per = F.array(*[F.struct(F.lit(c).alias("col"), tokens_of(F.col(c)).alias("words")) for c in columns])
    flat = t.select(F.col("id").alias("entry_id"), F.explode(per).alias("e")).select("entry_id", "e.col", F.posexplode("e.words").alias("pos", "token"))
    return flat.select(stem_column(F.col("token")).alias("token") if stemmed else F.col("token"), "entry_id", "col", "pos")


def _phrases(texts: DataFrame, stemmed: bool) -> DataFrame:
    """(phrase, n): the words of every text joined by blanks, and how many; texts without a word give none."""
    words = texts.select(tokens_of(F.col("text")).alias("words")).distinct().select("words", F.posexplode("words").alias("i", "token"))
    words = words.select("words", "i", stem_column(F.col("token")).alias("token") if stemmed else F.col("token"))
    inner = words.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("w"))
    return inner.select(F.array_join("w.token", " ").alias("phrase"), F.size("w").alias("n")).distinct()


def _holding(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(entry_id) with the words of any phrase next to each other in one column.

    The runs of words as long as some phrase are joined with the phrases, so
    the work grows with the index and not with index times phrases.
    """
    lengths = sorted(r["n"] for r in phrases.select("n").distinct().collect())  # the lengths of phrases, a term has few words
    if not lengths:
        return index.select("entry_id").filter("false")
    tokens = phrases.select(F.explode(F.split("phrase", " ")).alias("token")).distinct()
    at = index.join(tokens, "token", "left_semi").groupBy("entry_id", "col").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("w"))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.slice("w", i, n))
        near = F.filter(every, lambda r: F.element_at(r, -1)["pos"] - F.element_at(r, 1)["pos"] == n - 1)
        return F.when(F.size("w") >= n, F.transform(near, lambda r: F.array_join(r["token"], " ")))

    none = F.array().cast("array<string>")
    held = at.select("entry_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(runs(n), none) for n in lengths]))).alias("phrase"))
    return held.join(phrases, "phrase", "left_semi").select("entry_id").distinct()


def search_index(store: DataFrame, index: DataFrame, terms: list[str], synonyms: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """Facts that hold any of the terms, or of their synonyms, as a phrase; without a hit, the substring search.

    ``synonyms`` (term, synonym) expands the terms, all of them however many
    there are.  Phrases are taken apart like the indexed columns.
    """
    if not terms:
        return search_multi(store, terms)
    work = Work(store.sparkSession, "search")
    keys = [t.lower().replace(" ", "_") for t in terms]
    texts = store.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("text"))
    if synonyms is not None:
        texts = texts.unionByName(synonyms.filter(F.col("term").isin(keys)).select(F.col("synonym").alias("text")))
    ids = work.put(_holding(index, work.put(_phrases(texts, stemmed))))
    if ids.isEmpty():
        return search_multi(store, terms)
    return store.join(ids.withColumnRenamed("entry_id", "id"), "id", "left_semi")
