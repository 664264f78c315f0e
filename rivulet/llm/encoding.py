"""Encoding of whole texts with a public byte-level BPE: tree concatenation.

Short texts are encoded at once.  A long text is halved again and again, near
the middle at a place where the pre-tokeniser certainly cuts, or inside an
unsplit run where there is no such place.  The leaves are encoded in parallel;
then neighbours are joined: growing windows around the join are encoded again
until the window's first and last tokens agree with both sides.

Why the result is exact: a certain cut changes nothing.  Inside one run of
letters, digits or other signs (one pre-token) a token sequence is the BPE
encoding of its bytes exactly if each pair of neighbours in it is the encoding
of the pair's bytes; the pairs of left, window and right are pairs of valid
encodings, and the pairs across are too when a token is shared at each end.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.tables import Work

#: Texts up to so many characters are leaves.
LEAF = 32_768
#: A certain cut is looked for so far to both sides of the middle.
REACH = 2_048
#: The first window takes so many tokens of each side.
WINDOW = 8

#: A place where the pre-tokeniser cuts whatever stands before: after a letter or digit, before another kind of sign.
_CERTAIN = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")
_LETTER, _DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
#: Runs of letters or digits at the end (searched backwards) and at the start of a text.
_ENDING = (regex.compile(r"(?r)\p{L}+"), regex.compile(r"(?r)\p{N}+"))
_STARTING = (regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Vocabulary file: in ``folder``, in the folder named by RIVULET_TOKENIZERS, or in the installed package of public tokenizers."""
    folder = folder or os.environ.get("RIVULET_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, Encoder] = {}


class Encoder:
    """A byte-level BPE by its ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.whole = tiktoken.Encoding("rivulet", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _LOADED:
            _LOADED[path] = Encoder(path)
        return _LOADED[path]

    def encode(self, text: str) -> list[int]:
        return self.whole.encode_ordinary(text)

    def encode_run(self, raw: bytes) -> list[int]:
        """Ids of bytes taken as one pre-token: the pair of lowest rank is merged first, the leftmost of equal ones."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # by its first byte, where a part ends; 0 for what was merged into another
        before = list(range(-1, n - 1))
        heap = [(ranks[raw[i : i + 2]], i, i + 2) for i in range(n - 1) if raw[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                pair = raw[i : end[stop]]
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], i, end[stop]))
            left = before[i]
            if left >= 0 and raw[left:stop] in ranks:
                heapq.heappush(heap, (ranks[raw[left:stop]], left, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[raw[i : end[i]]])
            i = end[i]
        return ids


def split_point(text: str, at: int) -> tuple[int, bool]:
    """The certain cut nearest to ``at`` within REACH, else ``at`` itself inside a run: (place, certain)."""
    low, high = max(1, at - REACH), min(len(text) - 1, at + REACH)
    best = None
    for m in _CERTAIN.finditer(text, low, high):
        if best is None or abs(m.start() - at) < abs(best - at):
            best = m.start()
    return (best, True) if best is not None else (at, False)


def leaves(text: str, leaf: int = LEAF) -> list[tuple[str, bool]]:
    """The text in halves of halves, in order: (piece, whether its start is a certain cut)."""
    out: list[tuple[str, bool]] = []
    stack = [(0, len(text), True)]
    while stack:
        start, end, certain = stack.pop()
        if end - start <= leaf:
            out.append((text[start:end], certain))
            continue
        at, sure = split_point(text[start:end], (end - start) // 2)
        stack.append((start + at, end, sure))
        stack.append((start, start + at, certain))
    return out


def _kind(c: str) -> int:
    """0 for letters, 1 for digits, 2 for anything else."""
    return 0 if _LETTER.match(c) else 1 if _DIGIT.match(c) else 2


class Piece:
    """Encoded text whose left and right ends can still be joined."""

    __slots__ = ("text", "ids")

    def __init__(self, text: str, ids: list[int]):
        self.text, self.ids = text, ids


def join(encoder: Encoder, left: Piece, right: Piece, certain: bool) -> Piece:
    """The encoding of left.text + right.text from both encodings."""
    text = left.text + right.text
    if certain or not left.text or not right.text:
        return Piece(text, left.ids + right.ids)
    kind = _kind(right.text[0])
    # letters and digits only: runs of other signs may hold contractions or line ends, which the pre-tokeniser treats apart
    if kind < 2 and kind == _kind(left.text[-1]):
        bytes_l = len(_ENDING[kind].match(left.text).group().encode())
        bytes_r = len(_STARTING[kind].match(right.text).group().encode())
        k = WINDOW
        while True:
            k_l, k_r = min(k, len(left.ids)), min(k, len(right.ids))
            tail, head = left.ids[len(left.ids) - k_l :], right.ids[:k_r]
            raw_l = b"".join(encoder.bytes_of[i] for i in tail)
            raw_r = b"".join(encoder.bytes_of[i] for i in head)
            if len(raw_l) >= bytes_l - 1 or len(raw_r) >= bytes_r - 1:
                break  # the window would leave the run: encode it with the rules of the pre-tokeniser, below
            window = encoder.encode_run(raw_l + raw_r)
            if window[0] == tail[0] and window[-1] == head[-1]:
                return Piece(text, left.ids[: len(left.ids) - k_l] + window + right.ids[k_r:])
            k *= 2
    # the window reaches from the last certain cut on the left to the first on the right
    start = 0
    size = REACH
    while True:
        low = max(0, len(left.text) - size)
        cuts = [m.start() for m in _CERTAIN.finditer(left.text, max(low, 1), len(left.text) - 1)]
        if cuts:
            start = cuts[0]
            break
        if low == 0:
            break
        size *= 2
    end = len(right.text)
    size = REACH
    while True:
        m = _CERTAIN.search(right.text, 1, min(len(right.text), size))
        if m:
            end = m.start()
            break
        if size >= len(right.text):
            break
        size *= 2
    window = encoder.encode(left.text[start:] + right.text[:end])
    head = len(encoder.encode(left.text[start:])) if start else len(left.ids)
    tail = len(encoder.encode(right.text[:end])) if end < len(right.text) else len(right.ids)
    return Piece(text, left.ids[: len(left.ids) - head] + window + right.ids[tail:])


def concatenate(encoder: Encoder, pieces: list[tuple[str, list[int], bool]]) -> list[int]:
    """Join encoded leaves pairwise, level by level, to the encoding of the whole text."""
    level = [(Piece(t, ids), sure) for t, ids, sure in pieces]
    while len(level) > 1:
        nxt = []
        for i in range(0, len(level), 2):
            if i + 1 < len(level):
                nxt.append((join(encoder, level[i][0], level[i + 1][0], level[i + 1][1]), level[i][1]))
            else:
                nxt.append(level[i])
        level = nxt
    return level[0][0].ids if level else []


def _encode_short(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [encoder.encode(t) if t else [] for t in pdf["text"].fillna("")]})

    return run


def _cut(leaf: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"]):
                parts = leaves(text, leaf)
                yield pd.DataFrame({"doc_id": [doc] * len(parts), "row": [row] * len(parts), "part": range(len(parts)), "text": [p for p, _ in parts], "certain": [c for _, c in parts]})

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(path)
        for pdf in batches:
            yield pdf.assign(ids=[encoder.encode(t) for t in pdf["text"]])

    return run


def _concatenate(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        ids = concatenate(Encoder.of(path), [(t, [int(x) for x in i], bool(c)) for t, i, c in zip(pdf["text"], pdf["ids"], pdf["certain"])])
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "ids": [ids]})

    return run


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids): token ids of every row by a byte-level BPE without special tokens.

    Null and empty texts give an empty list; strings that look like special
    tokens are ordinary text.  One result row per input row, repeated ids
    included.  Texts of up to ``leaf`` characters are encoded in their own
    task without a shuffle; longer ones are cut into leaves, spread over the
    cluster and joined per text (a result row holds one whole list anyway).
    """
    path = path or tokenizer_path()
    Work(df.sparkSession, "encoding")
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    out = rows.filter(size <= leaf).mapInPandas(_encode_short(path), "doc_id bigint, ids array<int>")
    long = rows.filter(size > leaf)
    if long.isEmpty():
        return out
    work = Work(df.sparkSession, "encoding")
    parts = long.withColumn("row", F.monotonically_increasing_id()).mapInPandas(_cut(leaf), "doc_id bigint, row bigint, part int, text string, certain boolean")
    parts = work.put(parts)  # fixes the row numbers, should a task run again
    spread = parts.repartition(F.xxhash64("row", "part"))
    encoded = spread.mapInPandas(_encode_leaves(path), "doc_id bigint, row bigint, part int, text string, certain boolean, ids array<int>")
    joined = encoded.groupBy("row").applyInPandas(_concatenate(path), "doc_id bigint, ids array<int>")
    return out.unionByName(joined)
