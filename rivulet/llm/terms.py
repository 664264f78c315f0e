"""How often every distinct term occurs: burst-trie counting.

Every worker counts its rows in burst tries: terms are routed by their first
characters to small containers, and a container that grows beyond BURST terms
bursts into one container per next character.  Only containers leave the
worker.  Prefixes whose subtrees are too large in sum are cut deeper, so the
routing adapts to the data; matching subtrees of all workers are then merged.
A subtree that is still too large, because many workers have it or its terms
lie deeper than any worker's containers, is merged in lots, and the lots' few
counters of each term are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import insert_norm_py
from rivulet.tables import Work

#: A container bursts beyond so many terms.
BURST = 256
#: A merge takes at most about so many (worker, term) counters; a larger subtree is cut at the next character, or into lots.
MERGE = 20_000
#: A worker sends its tries on when they hold so many terms, and starts anew.
HELD = 200_000
#: No more cut prefixes than that are held by every worker; what would need more is merged in lots.
MOST_CUTS = 50_000


class BurstTrie:
    """Counters (occurrences, records) by term; inner nodes are routed by character, leaves are containers."""

    __slots__ = ("node", "size")

    def __init__(self):
        self.node: dict = {}  # character -> node (dict) or container (list of one dict); '' -> counters of the path itself
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth = self.node, 0
        while True:
            if depth == len(term):
                spot = node.get("")
                if spot is None:
                    node[""] = [occurrences, records]
                    self.size += 1
                else:
                    spot[0] += occurrences
                    spot[1] += records
                return
            c = term[depth]
            below = node.get(c)
            depth += 1
            if below is None:
                below = node[c] = [{}]
            if type(below) is dict:
                node = below
                continue
            held = below[0]
            rest = term[depth:]
            spot = held.get(rest)
            if spot is not None:
                spot[0] += occurrences
                spot[1] += records
                return
            held[rest] = [occurrences, records]
            self.size += 1
            if len(held) > BURST:
                node[c] = self._burst(held)
            return

    @staticmethod
    def _burst(held: dict) -> dict:
        node: dict = {}
        for rest, counters in held.items():
            if not rest:
                node[""] = counters
            else:
                node.setdefault(rest[0], [{}])[0][rest[1:]] = counters
        return node

    def containers(self) -> Iterator[tuple[str, dict]]:
        """(prefix, {rest: counters}) of every container; counters at an inner node come as a container of their own."""
        stack: list[tuple[str, dict]] = [("", self.node)]
        while stack:
            prefix, node = stack.pop()
            for c, below in node.items():
                if c == "":
                    yield prefix, {"": below}
                elif type(below) is dict:
                    stack.append((prefix + c, below))
                else:
                    yield prefix + c, below[0]


_TRIE_SCHEMA = "kind string, field string, prefix string, terms array<string>, occ array<bigint>, rec array<bigint>, n bigint"
_NO_LIST: list = []


def _grow(fields: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = {f: BurstTrie() for f in fields}
        records = dict.fromkeys(fields, 0)

        def sent() -> pd.DataFrame:
            rows = []
            for f, trie in tries.items():
                weights: dict[str, int] = {}
                for prefix, held in trie.containers():
                    rows.append(("c", f, prefix, [prefix + r for r in held], [v[0] for v in held.values()], [v[1] for v in held.values()], len(held)))
                    for i in range(1, len(prefix) + 1):
                        weights[prefix[:i]] = weights.get(prefix[:i], 0) + len(held)
                    for r in held:
                        if r:
                            weights[prefix + r[0]] = weights.get(prefix + r[0], 0) + 1
                rows += [("w", f, p, _NO_LIST, _NO_LIST, _NO_LIST, n) for p, n in weights.items()]
                rows.append(("r", f, "", _NO_LIST, _NO_LIST, _NO_LIST, records[f]))
                records[f] = 0
                tries[f] = BurstTrie()
            return pd.DataFrame(rows, columns=["kind", "field", "prefix", "terms", "occ", "rec", "n"])

        for pdf in batches:
            for f in fields:
                trie = tries[f]
                # equal values of a batch are taken apart once
                for value, times in pdf[f].value_counts(sort=False).items():
                    norm = insert_norm_py(value)
                    if not norm:
                        continue
                    records[f] += times
                    pieces = [x for x in norm.replace(",", "_").split("_") if x]
                    if len(pieces) == len(set(pieces)):
                        for x in pieces:
                            trie.add(x, times, times)
                    else:
                        for x in set(pieces):
                            trie.add(x, times * pieces.count(x), times)
            if sum(t.size for t in tries.values()) > HELD:
                yield sent()
        yield sent()

    return run


def _route(cuts: dict[str, set[str]]):
    """Terms under their subtree's prefix: the shortest one of the term that isn't cut, or the term itself where all are.

    That is the same for a term whichever container of a worker held it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lot = 0
        for pdf in batches:
            rows = []
            for field, prefix, terms, occ, rec in zip(pdf.field, pdf.prefix, pdf.terms, pdf.occ, pdf.rec):
                inner = cuts.get(field, ())
                to = next((prefix[:i] for i in range(1, len(prefix) + 1) if prefix[:i] not in inner), None)
                lot += 1
                if to is not None:
                    rows.append((field, to, lot, terms, occ, rec))
                    continue
                deeper: dict[str, list] = {}
                for t, o, r in zip(terms, occ, rec):  # the whole container is cut: workers that burst deeper have its terms further down
                    to = next((t[:i] for i in range(len(prefix) + 1, len(t) + 1) if t[:i] not in inner), t)
                    part = deeper.setdefault(to, [[], [], []])
                    part[0].append(t)
                    part[1].append(o)
                    part[2].append(r)
                rows += [(field, p, lot, *part) for p, part in deeper.items()]
            yield pd.DataFrame(rows, columns=["field", "subtree", "lot", "terms", "occ", "rec"])

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Matching subtrees of all workers as one."""
    trie = BurstTrie()
    for terms, occ, rec in zip(pdf.terms, pdf.occ, pdf.rec):
        for t, o, r in zip(terms, occ, rec):
            trie.add(t, int(o), int(r))
    rows = [(p + r, v[0], v[1]) for p, held in trie.containers() for r, v in held.items()]
    out = pd.DataFrame(rows, columns=["term", "occurrences", "records"])
    out.insert(0, "field", pdf.field.iloc[0] if len(pdf) else "")
    return out


def in_lots(routed: DataFrame, heavy: DataFrame) -> DataFrame:
    """``routed`` with ``part``: 0, or for the subtrees in ``heavy`` (field, subtree, n) one of as many parts as leave
    each with about half of MERGE counters."""
    parts = F.ceil(2 * F.col("n") / MERGE)
    part = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("lot", F.get("terms", F.lit(0)), F.size("terms")), parts)).cast("bigint")
    return routed.join(heavy, ["field", "subtree"], "left").withColumn("part", part).drop("n")


def merge_subtrees(routed: DataFrame, work: Work) -> DataFrame:
    """(field, term, occurrences, records) of all subtrees; no merge takes more than about MERGE counters."""
    schema = "field string, term string, occurrences bigint, records bigint"
    heavy = work.put(routed.groupBy("field", "subtree").agg(F.sum(F.size("terms")).alias("n")).filter(F.col("n") > MERGE))
    if heavy.isEmpty():
        return routed.groupBy("field", "subtree").applyInPandas(_merge, schema)
    lots = in_lots(routed, heavy).groupBy("field", "subtree", "part").applyInPandas(_merge, schema)
    return lots.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequencies(df: DataFrame, fields: list[str], rare: int = 2, common_parts: int = 20) -> DataFrame:
    """(field, term, occurrences, records, mark) for every distinct term of each field.

    A term is a non-empty piece between ``_`` and ``,`` of the field in insert
    normalisation.  ``mark`` is 'rare' for at most ``rare`` occurrences in the
    field, else 'common' for a term in more than one in ``common_parts`` of the records in
    which the field is non-empty after normalisation, else null.  Null, empty
    and blank values count as no record; a repeated row counts again; an empty
    table gives an empty result.  Each field is taken by itself.
    """
    spark = df.sparkSession
    work = Work(spark, "terms")
    tries = work.put(df.select(*[F.col(f).cast("string").alias(f) for f in fields]).mapInPandas(_grow(fields), _TRIE_SCHEMA))
    weights = tries.filter("kind = 'w'").groupBy("field", "prefix").agg(F.sum("n").alias("n"))
    largest = MERGE
    cuts = weights.filter(F.col("n") > largest)
    while cuts.limit(MOST_CUTS + 1).count() > MOST_CUTS:
        largest *= 4
        cuts = weights.filter(F.col("n") > largest)
    inner: dict[str, set[str]] = {}
    for r in cuts.select("field", "prefix").collect():  # at most MOST_CUTS rows
        inner.setdefault(r["field"], set()).add(r["prefix"])
    containers = tries.filter("kind = 'c'").select("field", "prefix", "terms", "occ", "rec")
    routed = work.put(containers.mapInPandas(_route(inner), "field string, subtree string, lot bigint, terms array<string>, occ array<bigint>, rec array<bigint>"))
    merged = merge_subtrees(routed, work)
    totals = {r["field"]: r["n"] for r in tries.filter("kind = 'r'").groupBy("field").agg(F.sum("n").alias("n")).collect()}  # one row a field
    total = F.coalesce(*[F.when(F.col("field") == f, F.lit(int(n))) for f, n in totals.items()], F.lit(0))
    mark = F.when(F.col("occurrences") <= rare, "rare").when(F.col("records") * common_parts > total, "common")
    return merged.withColumn("mark", mark)
