"""Records that are the same but for formatting: progressive partition refinement.

Records are stripped of their formatting once and then classed by keys of
rising cost: the lengths of the stripped fields, their letter histograms, and
the exact sorted members.  Each key is worked out only for the records that
shared a class with another one so far.  Which classes have several members is
told to all workers by a bitmap of bounded size, so that most records without a
copy leave before anything of theirs is shuffled; a bitmap only ever keeps too
many, and the exact key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.tables import Work, hot_keys, skew_join

_NOT_ALNUM = r"[^\p{L}\p{Nd},]+"
#: Bits of the bitmap of length classes, and the most that the bitmap of histogram classes may have (8 MB).
LENGTH_BITS, MOST_BITS = 1 << 20, 1 << 26


def _stripped(c: Column) -> Column:
    """Letters and digits in lower case; where commas divide members, the distinct non-empty ones in their order."""
    kept = F.regexp_replace(F.lower(c), _NOT_ALNUM, "")
    members = F.array_join(F.array_distinct(F.array_remove(F.split(kept, ","), "")), ",")
    return F.when(F.contains(kept, F.lit(",")), members).otherwise(kept)


def _sorted_members(s: Column) -> Column:
    return F.when(F.contains(s, F.lit(",")), F.array_join(F.sort_array(F.split(s, ",")), ",")).otherwise(s)


def _histogram(s: Column) -> Column:
    """A digest of how often each letter occurs, whatever the order: the sum of the letters' 32-bit hashes."""
    return F.aggregate(F.split(s, ""), F.lit(0).cast("bigint"), lambda a, x: a + F.hash(x).cast("bigint"))


def _bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(_word, _bits): one bit for each of ``keys``; at most bits / 64 rows."""
    at = F.pmod(F.col(key), F.lit(bits))
    return keys.select(F.shiftright(at, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _marked(df: DataFrame, key: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """Rows whose key has its bit set.  The bitmap is sent to all workers; its size is bounded by ``bits``."""
    at = F.pmod(F.col(key), F.lit(bits))
    hit = df.withColumn("_word", F.shiftright(at, 6)).join(F.broadcast(bitmap), "_word")
    return hit.filter(F.getbit("_bits", F.pmod(F.col(key), F.lit(bits)).bitwiseAND(63).cast("int")) == 1).drop("_word", "_bits")


def _several(df: DataFrame, key: str) -> DataFrame:
    """(key, _n) of the classes with more than one member."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")


def _prepared(df: DataFrame, id_col: str, fields: list[str], work: Work) -> DataFrame:
    """(_id, _f0, _f1, ...): records without formatting; those with a null id or an empty field are left out."""
    names = [f"_f{i}" for i in range(len(fields))]
    base = df.select(F.col(id_col).cast("bigint").alias("_id"), *[_stripped(F.col(c).cast("string")).alias(n) for c, n in zip(fields, names)])
    base = base.filter(F.col("_id").isNotNull())
    for n in names:
        base = base.filter(F.length(n) > 0)
    return work.put(base.withColumn("_len", F.xxhash64(*[F.length(n) for n in names])))


def _classes(records: DataFrame, work: Work, most_bits: int) -> DataFrame:
    """(entry_id, copy_id, n_copies) of all records with a copy."""
    names = [c for c in records.columns if c.startswith("_f")]
    total = records.count()
    # refinement by length
    by_length = _bitmap(_several(records, "_len"), "_len", LENGTH_BITS)
    long_enough = _marked(records, "_len", by_length, LENGTH_BITS)
    # by letter histogram, within the length
    keyed = long_enough.withColumn("_k", F.xxhash64("_len", *[_histogram(F.col(n)) for n in names])).drop("_len")
    classes = work.put(_several(keyed, "_k"))
    bits = min(most_bits, max(LENGTH_BITS, 1 << (8 * total).bit_length()))
    hot = hot_keys(classes, "_k", "_n", total)
    # by the exact members: only what shares a histogram class; the bitmap first, then the classes themselves
    likely = _marked(keyed, "_k", _bitmap(classes, "_k", bits), bits)
    exact = likely.select("_id", "_k", F.concat_ws("\x1f", *[_sorted_members(F.col(n)) for n in names]).alias("_key"))  # no member holds that separator
    members = work.put(skew_join(exact, classes.select("_k"), "_k", hot, "inner", "_id").select("_id", "_key"))
    groups = work.put(members.groupBy("_key").agg(F.min("_id").alias("entry_id"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1"))
    out = skew_join(members, groups, "_key", hot_keys(groups, "_key", "n_copies", total), "inner", "_id")
    return out.select("entry_id", F.col("_id").alias("copy_id"), "n_copies")


def formatting_copies(df: DataFrame, id_col: str, fields: list[str], most_bits: int = MOST_BITS) -> DataFrame:
    """Every record that has a copy, with its class: (entry_id, copy_id, n_copies).

    Two records are copies when each of ``fields`` has the same set of
    comma-separated members, of which only letters and digits count, in either
    case.  ``entry_id`` is the lowest id of the class; the row with
    ``copy_id == entry_id`` is the class's own.  Records in which a field is
    null, empty or without letters and digits are left out, as are records
    without a copy.  Rows with a null id are left out.  Other columns, whatever
    their names, are disregarded.  An empty table gives an empty result.
    ``most_bits`` bounds what is sent to the workers, not the result.
    """
    work = Work(df.sparkSession, "copies")
    return _classes(_prepared(df, id_col, fields, work), work, most_bits)


def facts(df: DataFrame, id_col: str, fields: list[str], most_bits: int = MOST_BITS) -> DataFrame:
    """Each fact once: (entry_id, n_copies); a record without a copy comes out with 1.

    Same rules as ``formatting_copies``.
    """
    work = Work(df.sparkSession, "facts")
    records = _prepared(df, id_col, fields, work)
    copies = work.put(_classes(records, work, most_bits))
    lead = copies.filter("entry_id = copy_id").select("entry_id", "n_copies").distinct()
    alone = records.select(F.col("_id").alias("entry_id")).join(copies.select(F.col("copy_id").alias("entry_id")), "entry_id", "left_anti")
    return lead.unionByName(alone.select("entry_id", F.lit(1).cast("bigint").alias("n_copies")))
