"""Evaluation passages inside corpus texts: size-partitioned MinHash containment search.

The question put to every item is whether it contains a passage of a document
whole: a piece of 12 words (8 shingles of five) or, for Chinese, 20 characters
(16 shingles).  Items are partitioned by the size of their shingle set; the
larger the partition, the smaller the chance that one MinHash of an item lies in
a given passage of it, so the more hash functions its sketches take: as many as
it needs until every passage of the item holds one of its minima.  A document
piece that an item contains then holds such a shingle, and the search has recall
1.  A document's shingles are looked up among the minima, the pieces around a
hit are verified by exact shingle containment: all shingles of the piece, in
their order, in the item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.tables import Work, hot_of, skew_join

SHINGLE = 5
#: Symbols of a piece.
PIECE = {"words": 12, "han": 20}
#: Items of more shingles than that are several overlapping ones: the top size partition.
LARGEST = 1_024
#: Hash functions are added so many at a time.
AT_A_TIME = 16
#: Items with up to so many distinct pieces are sent to every worker (their texts, and 8 bytes a minimum); more are joined by a shuffle.
SENT = 500_000
#: Bits of the two bitmaps that keep most pieces of documents out of that shuffle (8 MB each).
BITS = 1 << 26

_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]+")


def words(text: str) -> list[str]:
    """Words of a text; letter case, punctuation and spacing do not count."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def han_runs(text: str) -> list[str]:
    """Runs of Chinese characters, over punctuation and spacing, broken by other letters and digits."""
    return _HAN.findall("".join(_WORD.findall(unicodedata.normalize("NFKC", text))))


def item_kind(lang: str | None, text: str | None) -> str:
    """'han' for Chinese items (by lang, or by script where lang is unknown), else 'words'."""
    known = (lang or "").lower().split("-")[0]
    if known in ("", "und"):
        return "han" if 2 * sum(map(len, _HAN.findall(text or ""))) > len(text or "") else "words"
    return "han" if known == "zh" else "words"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _symbols(texts: list[str], kind: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' symbols in a row: symbols, their hashes, the number of their run, the text of each run."""
    parts: list = []
    lengths, owner = [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        for r in [words(t)] if kind == "words" else han_runs(t) if _HAN.search(t) else []:
            if len(r) >= PIECE[kind]:
                parts.append(r)
                lengths.append(len(r))
                owner.append(i)
    run = np.repeat(np.arange(len(parts)), lengths)
    if kind == "words":
        flat = [w for p in parts for w in p]
        hashes = pd.util.hash_array(np.array(flat, dtype=object)) if flat else np.empty(0, np.uint64)
    else:
        flat = "".join(parts)
        hashes = _mix(np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)) if flat else np.empty(0, np.uint64)
    return flat, hashes, run, np.array(owner, np.int64)


def _text(flat, at: int, kind: str) -> str:
    part = flat[at : at + PIECE[kind]]
    return " ".join(part) if kind == "words" else part


def _shingles(symbols: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the shingle that starts at each place, whether it lies in one run)."""
    n = len(symbols) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + symbols[i : n + i]
    return _mix(h), run[:n] == run[SHINGLE - 1 :]


def _piece_keys(symbols: np.ndarray, starts: np.ndarray, piece: int) -> np.ndarray:
    """A hash of the whole piece at each start."""
    h = np.zeros(len(starts), np.uint64)
    for i in range(piece):
        h = h * np.uint64(0xD6E8FEB86659FD93) + symbols[starts + i]
    return _mix(h)


def size_partition(shingles: int) -> int:
    """The partition of a shingle set: its size's power of two, LARGEST's at most."""
    return min(shingles, LARGEST).bit_length() - 1


def sketch(shingles: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """(minima, hash functions) of one item: MinHash functions are added until each of the ``windows`` (starts of
    ``length`` shingles) holds a minimum of the whole set."""
    seeds = np.random.default_rng(size_partition(len(np.unique(shingles)))).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)
    minima: set[int] = set()
    open_, used = windows, 0
    while len(open_):
        own = seeds[np.arange(used, used + AT_A_TIME) % len(seeds)] + np.uint64(used // len(seeds))
        used += AT_A_TIME
        least = _mix(shingles[None, :] ^ own[:, None]).argmin(axis=1)
        minima.update(shingles[least].tolist())
        held = np.concatenate(([0], np.cumsum(np.isin(shingles, shingles[least]))))
        open_ = open_[held[open_ + length] == held[open_]]
    return np.array(sorted(minima), np.uint64), used


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the items' index: their minima (what 'm': hash, size partition, hash functions), their pieces (what 'p': hash, text)."""
    for pdf in batches:
        rows = []
        for item, kind, text in zip(pdf["id"], pdf["kind"], pdf["text"]):
            piece = PIECE[kind]
            length = piece - SHINGLE + 1
            flat, symbols, run, _ = _symbols([text], kind)
            shingles, _ = _shingles(symbols, run)
            starts = np.nonzero(run[: max(len(run) - piece + 1, 0)] == run[piece - 1 :])[0]
            keys = _piece_keys(symbols, starts, piece)
            rows += [(item, kind, "p", k, _text(flat, a, kind), 0, 0) for a, k in zip(starts.tolist(), keys.view(np.int64).tolist())]
            # domains of at most LARGEST shingles, overlapping so that each piece lies whole in one of them
            for first in range(0, len(shingles), LARGEST - length + 1):
                own = starts[(starts >= first) & (starts + length <= first + LARGEST)]
                if len(own):
                    low, high = own[0], own[-1] + length
                    part = shingles[low:high]
                    minima, used = sketch(part, own - low, length)
                    size = size_partition(len(np.unique(part)))
                    rows += [(item, kind, "m", h, "", size, used) for h in minima.view(np.int64).tolist()]
        if rows:
            yield pd.DataFrame(rows, columns=["id", "kind", "what", "hash", "piece", "size", "functions"]).drop_duplicates()


_INDEX = "id bigint, kind string, what string, hash bigint, piece string, size int, functions int"


def _around(symbols: np.ndarray, run: np.ndarray, among, kind: str) -> np.ndarray:
    """Starts of the pieces that hold a shingle ``among`` the minima."""
    piece = PIECE[kind]
    length = piece - SHINGLE + 1
    shingles, whole = _shingles(symbols, run)
    hits = np.nonzero(whole & among(shingles))[0] if len(shingles) else np.empty(0, np.int64)
    if not len(hits):
        return hits
    # a piece's shingles are those from its start on: each hit lies in the pieces that start up to length - 1 before it
    edge = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edge, np.maximum(hits - length + 1, 0), 1)
    np.add.at(edge, hits + 1, -1)
    starts = np.nonzero(np.cumsum(edge)[: max(len(symbols) - piece + 1, 0)] > 0)[0]
    return starts[run[starts] == run[starts + piece - 1]]


def _in_sorted(known: np.ndarray):
    return lambda h: known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _in_bits(words: np.ndarray):
    """Membership in a bitmap: keeps a few too many, never too few."""

    def among(h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(64 * len(words) - 1)
        return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    return among


def _search(known: dict[str, tuple[np.ndarray, np.ndarray, dict[str, list[int]]]]):
    """Documents against items held in the worker: candidates by the minima, then the exact piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(), pdf["text"].tolist()
            found: set[tuple[int, int]] = set()
            for kind, (minima, keys, exact) in known.items():
                if not len(minima):
                    continue
                flat, symbols, runs, owner = _symbols(texts, kind)
                starts = _around(symbols, runs, _in_sorted(minima), kind)
                starts = starts[_in_sorted(keys)(_piece_keys(symbols, starts, PIECE[kind]))]
                for a in starts:
                    for item in exact.get(_text(flat, a, kind), ()):
                        found.add((int(ids[owner[runs[a]]]), item))
            if found:
                yield pd.DataFrame(sorted(found), columns=["doc_id", "item_id"])

    return run


def _likely(bits: dict[str, tuple[np.ndarray, np.ndarray]]):
    """Rows (id, piece) of the pieces of documents that hold a likely minimum and are a likely piece themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(), pdf["text"].tolist()
            for kind, (minima, keys) in bits.items():
                flat, symbols, runs, owner = _symbols(texts, kind)
                starts = _around(symbols, runs, _in_bits(minima), kind)
                starts = starts[_in_bits(keys)(_piece_keys(symbols, starts, PIECE[kind]))]
                if len(starts):
                    yield pd.DataFrame({"id": ids[owner[runs[starts]]], "piece": [f"{kind}\x1f{_text(flat, a, kind)}" for a in starts]}).drop_duplicates()

    return run


def _bitmap(index: DataFrame, bits: int) -> np.ndarray:
    """The hashes of ``index`` as a bitmap: bits / 64 words, whatever their number."""
    at = F.col("hash").bitwiseAND(bits - 1)
    words = index.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", item_lang: str = "lang", sent: int = SENT, bits: int = BITS) -> DataFrame:
    """(doc_id, item_id): every document that holds a piece of an item, with the item.

    A piece is 12 consecutive words of the item, or 20 consecutive Chinese
    characters of a Chinese item; letter case, punctuation and spacing do not
    count.  Whole texts are searched.  Null, empty and short texts hold no
    piece; rows with a null id are left out; a repeated pair comes out once;
    an empty table on either side gives an empty result.  ``sent`` and ``bits``
    (a power of two, 64 or more) choose the plan and bound what workers hold,
    not the result.
    """
    spark = documents.sparkSession
    work = Work(spark, "leakage")
    docs = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null and text is not null")
    index = work.put(item_index(items, item_id, item_text, item_lang))
    pieces = index.filter("what = 'p'")
    if index.limit(sent + 1).count() <= sent:
        rows = index.toPandas()  # at most ``sent`` rows
        known = {}
        for k in PIECE:
            own = rows[rows["kind"] == k]
            part = own[own["what"] == "p"]
            exact: dict[str, list[int]] = {}
            for i, p in zip(part["id"].tolist(), part["piece"].tolist()):
                exact.setdefault(p, []).append(i)
            hashes = lambda what, own=own: np.unique(own.loc[own["what"] == what, "hash"].to_numpy(np.int64).view(np.uint64))
            known[k] = (hashes("m"), hashes("p"), exact)
        return docs.mapInPandas(_search(known), "doc_id bigint, item_id bigint").distinct()
    # many items: bitmaps of bounded size leave the likely pieces, which are joined with the items' own
    both = {k: tuple(_bitmap(index.filter((F.col("kind") == k) & (F.col("what") == w)), bits) for w in "mp") for k in PIECE}
    likely = work.put(docs.mapInPandas(_likely(both), "id bigint, piece string"))
    targets = pieces.select(F.col("id").alias("item_id"), F.concat_ws("\x1f", "kind", "piece").alias("piece")).distinct()
    return skew_join(likely, targets, "piece", hot_of(likely, "piece"), "inner", "id").select(F.col("id").alias("doc_id"), "item_id").distinct()


def item_index(items: DataFrame, item_id: str = "item_id", item_text: str = "text", item_lang: str = "lang") -> DataFrame:
    """The items' minima and pieces: (id, kind, what, hash, piece, size, functions), 'm' rows with the size partition and
    the hash functions it took, 'p' rows with the piece."""
    kind = F.pandas_udf(_kinds, "string")
    own = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).cast("string").alias("text"), F.col(item_lang).cast("string").alias("lang")).filter("id is not null and text is not null")
    return own.select("id", "text", kind("lang", "text").alias("kind")).mapInPandas(_sketched, _INDEX).distinct()


def _kinds(lang: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([item_kind(a if isinstance(a, str) else None, t) for a, t in zip(lang, text)], dtype=object)


_kinds.__annotations__ = {"lang": pd.Series, "text": pd.Series, "return": pd.Series}
