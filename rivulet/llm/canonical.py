"""Free-entered values to the entries of a reference list.

A multi-pattern automaton over all canonical names and aliases finds embedded
mentions, of which the longest non-overlapping one wins; values without a
mention go to token-set similarity.  Every worker maps the distinct spellings
it meets, so nothing is shuffled and no value can be a hot key.

Every answer has a rank, (stage, -score, place, original), and the least one
wins.  It is a property of the value and the entry alone, so a list that is
matched in blocks gives the same answers as one that is matched at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import insert_norm_py
from rivulet.tables import Work, hot_keys, skew_join

#: A worker holds so many entries of the reference list at once; a longer list is matched in blocks, with the same answers.
BLOCK = 20_000
#: A worker remembers so many spellings of up to so many characters (a cache; others are worked out again).
REMEMBERED, REMEMBERED_SIZE = 200_000, 200
#: Least similarity of a match.  Fitted on the 12,410 distinct word sequences of the test tables' predicates: the best entry
#: of those that stand for one scores 0.50 or more, that of those that stand for none 0.42 or less.
LEAST = 0.46
#: Letters that only the value has weigh so much against it, letters that only the entry has weigh 1: values carry small words.
FOREIGN = 0.7

#: Stages of an answer, best first.
EXACT, JOINED, ANY_ORDER, MENTION, SIMILAR = range(5)

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SEPARATOR = re.compile(r"[\W_]+")


def tokens(value: str) -> list[str]:
    """Words of a value: lower case, invisible characters deleted, every other sign a separator."""
    return [t for t in _SEPARATOR.split(_INVISIBLE.sub("", value).lower()) if t]


@lru_cache(maxsize=REMEMBERED)
def in_common(a: str, b: str) -> int:
    """Letters of the longer string less the slips (insertions, deletions, substitutions, swaps of neighbours) between both."""
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = before[j - 1] if x == y else 1 + min(before[j], row[j - 1], before[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before2[j - 2] + 1)
            row.append(best)
        before2, before = before, row
    return max(len(a), len(b)) - before[-1]


def similarity(value: tuple[str, ...], entry: tuple[str, ...]) -> float:
    """Token-set similarity in letters: common / (common + FOREIGN * value's own + entry's own), from 0 to 1.

    Each token is matched with at most one of the other side, the most alike
    first and only where half of the letters agree.  Where tokens ran together
    both sides count as one token, with equal weights; the better one holds.
    """
    whole, name = "".join(value), "".join(entry)
    n, m = len(whole), len(name)
    alike = lambda a, b: 2 * min(len(a), len(b)) >= max(len(a), len(b)) <= 2 * in_common(a, b)
    pairs = sorted((-in_common(a, b), i, j) for i, a in enumerate(value) for j, b in enumerate(entry) if alike(a, b))
    used_a, used_b, common = set(), set(), 0
    for c, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            common -= c
    as_sets = common / (common + FOREIGN * (n - common) + (m - common)) if common else 0.0
    joined = in_common(whole, name)
    return max(as_sets, joined / (n + m - joined))


def _letters(words: list[str]) -> np.ndarray:
    m = np.zeros((len(words), 37), np.int16)
    for i, w in enumerate(words):
        for c in w:
            o = ord(c)
            m[i, o - 97 if 97 <= o < 123 else o - 22 if 48 <= o < 58 else 36] += 1
    return m


class Matcher:
    """One block of the reference list, ready to match."""

    def __init__(self, listed: list[tuple[str, str]]):
        self.by_tokens: dict[tuple, tuple[str, str]] = {}
        self.by_joined: dict[str, tuple[str, str]] = {}
        self.any_order: dict[tuple, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        self.known: dict[tuple, tuple | None] = {}
        self.entries = []
        for original, canonical in sorted(set(listed)):
            ts = tuple(tokens(original))
            if not ts:
                continue
            self.entries.append((ts, original, canonical))
            self.by_tokens.setdefault(ts, (original, canonical))
            self.by_joined.setdefault("".join(ts), (original, canonical))
            self.any_order.setdefault(tuple(sorted(set(ts))), (original, canonical))
            for p in permutations(ts) if 1 < len(ts) <= 4 else ():  # run together in another order
                self.any_order.setdefault(("".join(p),), (original, canonical))
            word = f"_{'_'.join(ts)}_"
            if word not in self.automaton:
                self.automaton.add_word(word, (len(word) - 2, original, canonical))
        self.some = bool(self.entries)
        if self.some:
            self.automaton.make_automaton()
            self.counts = _letters(["".join(t) for t, _, _ in self.entries])
            self.sizes = self.counts.sum(1)

    def mention(self, ts: tuple[str, ...]) -> tuple | None:
        """The longest mention, which the longest non-overlapping ones begin with; it must make up half of the value."""
        text = f"_{'_'.join(ts)}_"
        found = min(((-n, end - n, original, canonical) for end, (n, original, canonical) in self.automaton.iter(text)), default=None)
        if found is None or -2 * found[0] < len(text) - 2:
            return None
        return MENTION, -(1.0 - (len(text) - 2 + found[0]) / 1000), *found[1:]

    def similar(self, ts: tuple[str, ...]) -> tuple | None:
        """The most similar entry.  Equal letters bound the similarity from above, so entries are tried by that bound
        until it falls below the best one; none is left out that could win."""
        own = _letters(["".join(ts)])
        common = np.minimum(self.counts, own).sum(1)
        n = int(own.sum())
        bound = np.maximum(common / np.maximum(common + FOREIGN * (n - common) + (self.sizes - common), 1), common / np.maximum(n + self.sizes - common, 1))
        near = np.nonzero(bound >= LEAST - 1e-9)[0]
        best = None
        for i in near[np.argsort(-bound[near], kind="stable")]:
            if best is not None and bound[i] < -best[1] - 1e-9:
                break
            entry, original, canonical = self.entries[i]
            s = similarity(ts, entry)
            if s >= LEAST:
                rank = (SIMILAR, -s, 0, original, canonical)
                best = rank if best is None else min(best, rank)
        return best

    def match(self, value: str) -> tuple[int, float, int, str, str] | None:
        """(stage, -score, place, original, canonical) of the best entry, or None."""
        ts = tuple(tokens(value))
        if not ts or not self.some:
            return None
        for stage, hit in ((EXACT, self.by_tokens.get(ts)), (JOINED, self.by_joined.get("".join(ts))), (ANY_ORDER, self.any_order.get(tuple(sorted(set(ts)))))):
            if hit:
                return stage, -1.0, 0, *hit
        if ts not in self.known:  # many spellings come down to the same words
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.mention(ts) or self.similar(ts)
            if len(value) > REMEMBERED_SIZE:
                return found
            self.known[ts] = found
        return self.known[ts]


def _map_rows(listed: list[tuple[str, str]]):
    """Rows (id, value) straight to their answers: the whole list is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, known, skip = Matcher(listed), {}, {o for o, _ in listed}

        def one(value: str) -> tuple[bool, float, str]:
            if value in skip or not insert_norm_py(value):
                return False, 0.0, ""
            hit = matcher.match(value)
            return (True, -hit[1], hit[4]) if hit else (True, 0.0, "unmatched")

        for pdf in batches:
            codes, values = pd.factorize(pdf["value"])
            found = []
            for v in values:
                r = known.get(v)
                if r is None:
                    r = one(v)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    if len(v) <= REMEMBERED_SIZE:
                        known[v] = r
                found.append(r)
            if not found:
                continue
            keep = np.array([r[0] for r in found] + [False])[codes]
            rows = codes[keep]
            yield pd.DataFrame({"entry_id": pdf["id"].to_numpy()[keep], "score": np.array([r[1] for r in found])[rows], "canonical": np.array([r[2] for r in found], object)[rows]})

    return run


def _map_spellings(listed: list[tuple[str, str]]):
    """Distinct values to their best answer within one block; values without one give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(listed)
        for pdf in batches:
            rows = [(v, *hit) for v in pdf["value"] if (hit := matcher.match(v))]
            yield pd.DataFrame(rows, columns=["value", "stage", "less", "place", "original", "canonical"])

    return run


def _filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[bool(insert_norm_py(v)) for v in pdf["value"]]]


def canonical_names(df: DataFrame, id_col: str, value_col: str, reference: DataFrame, original: str, canonical: str, block: int | None = None) -> DataFrame:
    """(entry_id, score, canonical): the canonical name that each freely typed value stands for.

    Rows whose value is null, empty after insert normalisation or, character
    for character, a listed original are left out.  ``canonical`` is that of
    the listed original found first of: the same words; the same words run
    together; the same words in any order (score 1.0 so far); the longest
    mention inside a value that it makes up half of (a little less); the most
    similar one by token sets, LEAST or more.  Else it is 'unmatched' with
    score 0.  Ties fall to the original that comes first in code point order.
    Reference rows with a null side are no entries; repeated ones count once;
    when an original has several canonical names, the first in code point
    order holds.  An empty reference list leaves every value unmatched.  Other
    columns are disregarded.  A list beyond ``block`` entries is matched in
    blocks against the distinct spellings, with the same answers.
    """
    block = block or BLOCK
    spark = df.sparkSession
    work = Work(spark, "canonical")
    listed_rows = reference.select(F.col(original).alias("o"), F.col(canonical).alias("c")).filter("o is not null and c is not null").groupBy("o").agg(F.min("c").alias("c"))
    values = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(value_col).cast("string").alias("value")).filter("value is not null")
    size = listed_rows.count()
    if size <= block:
        listed = [(r["o"], r["c"]) for r in listed_rows.collect()]  # at most ``block`` rows
        return values.mapInPandas(_map_rows(listed), "entry_id bigint, score double, canonical string")
    parts = -(-size // block)
    blocks = work.put(listed_rows.withColumn("b", F.pmod(F.xxhash64("o"), F.lit(parts)).cast("int")))
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).join(listed_rows.select(F.col("o").alias("value")), "value", "left_anti")
    spellings = work.put(counted.mapInPandas(_filled, "value string, n bigint"))
    found = []
    for b in range(parts):
        listed = [(r["o"], r["c"]) for r in blocks.filter(F.col("b") == b).select("o", "c").collect()]  # about ``block`` rows
        found.append(spellings.select("value").mapInPandas(_map_spellings(listed), "value string, stage int, less double, place int, original string, canonical string"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy("value").agg(F.min(F.struct("stage", "less", "place", "original", "canonical")).alias("a"))
    answers = work.put(spellings.join(best, "value", "left").select("value", "n", F.coalesce(-F.col("a.less"), F.lit(0.0)).alias("score"), F.coalesce("a.canonical", F.lit("unmatched")).alias("canonical")))
    hot = hot_keys(answers, "value", "n", answers.agg(F.sum("n")).first()[0] or 0)
    out = skew_join(values, answers.select("value", "score", "canonical"), "value", hot, "inner", "id")
    return out.select(F.col("id").alias("entry_id"), "score", "canonical")
