"""Sentence boundaries across languages and scripts: a maximum-entropy classifier.

Candidates are marks (of any script) before white space, before the next
character in scripts without spaces, or before closing quotes and brackets.
What the layout settles is never asked: blank lines, list lines, spaces in
Thai, places inside quotations and brackets.  Everything else is classified.

Reliable boundaries train the classifier: a mark at the end of a paragraph is
one, and a mark is none when its token, counted over the whole corpus, never
ends a paragraph or the token after it never begins one, too often for chance.

Every text is read once.  What was found is kept as one row a document: the
pieces between possible boundaries and, of each boundary, hashes of the tokens
around it and their traits.  Statistics of all tokens of all documents are
counted from that table, and whole batches of boundaries are classified by one
matrix product.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.tables import Work, hot_keys, skew_join

#: Labelled rows that the classifier is fitted on, at most; drawn by hash from all documents.
SAMPLE_ROWS = 20_000
#: Documents from which they are drawn, about.
SAMPLE_DOCS = 4_000
#: Token statistics of up to so many rows are sent to every worker (24 bytes each); more are joined.  Both give the same.
SENT = 1_000_000
#: A token's own share of paragraph ends counts as much as that of its shape when it was seen so often.
PRIOR = 0.5
#: A token counts as never ending (or beginning) a paragraph when chance would do that less often than this.
CHANCE = 1e-5

#: Marks that may end a sentence, closing signs, opening signs, list marks.
_MARKS = ".!?…。！？｡．।॥؟۔։።"
_NO_SPACE = "。！？｡．"
_CLOSE = "\"”’»›)]}」』）》】〉"
_OPEN = "\"“„‟‘«‹([{「『（《【〈¿¡'"
_PAIRS = {"“": "”", "„": "“", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "《": "》", "【": "】"}
_MARK_RUN = re.compile(f"[{re.escape(_MARKS)}]+")
_BLANK = re.compile("\\n[^\\S\\n]*\\n\\s*| \\s*")
_BULLET = re.compile(r"[^\S\n]*[-*•‣◦·▪]\s")
_NUMBER = re.compile(r"[^\S\n]*(?:\(?\d{1,3}[.)]|[–—]|[A-Za-z]\))\s")
_LISTED = re.compile(r"\n[^\S\n]*(?:[-*•‣◦·▪]|\(?\d{1,3}[.)]|[–—]|[A-Za-z]\))\s")
_QUOTED = re.compile("[\"“”„«»()\\[\\]「」『』（）《》【】]")
_WORD = re.compile(r"[\w][\w'’\-]*")
_DIGITS = re.compile(r"\d+")
_IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_THAI = re.compile("[฀-๿]")
_THAI_GAP = re.compile("(?<=[฀-๏๚-๿\"”’)])\\s+(?=[฀-๏\"“‘(])")



#: What is kept of a possible boundary: whether a mark stands there, the last one of its block, settled by the layout.
MARK, LAST, SETTLED = 1, 2, 4
#: Traits of the token before a mark and of the one after it, in the order of the features.
_AFTER_TRAITS = ("upper", "lower", "digit", "opened", "ideograph")
_BEFORE_TRAITS = ("one letter", "two or three", "capital", "ends in digit", "inner dot", "full stop", "ellipsis", "no space", "closed")
_SOME_AFTER = 1 << (len(_AFTER_TRAITS) + len(_BEFORE_TRAITS))

@lru_cache(maxsize=100_000)
def _shape(token: str) -> str:
    """Script, case and length of a token."""
    if not token:
        return "-"
    c = token[0]
    if c.isdigit():
        return "9" if token.isalnum() else "9+"
    if _IDEOGRAPH.match(c):
        return "H"
    script = unicodedata.name(c, "?").split(" ")[0][:6]
    if len(token) == 1:
        return f"{script}:1{'A' if c.isupper() else 'a'}"
    inner = "." if "." in token[:-1] else ""
    case = "A" if token.isupper() else "Aa" if c.isupper() else "a"
    return f"{script}:{case}{inner}{min(len(token), 4) if not inner else ''}"


def _bits(flags: list[bool], start: int) -> int:
    return sum(1 << (start + i) for i, f in enumerate(flags) if f)


class _Codes(dict):
    """Codes of what was met; the entries' keys, shapes and traits by code."""

    def __init__(self, make):
        self.make, self.key, self.shape, self.bits = make, [], [], []

    def __missing__(self, met: tuple) -> int:
        key, shape, bits = self.make(*met)
        self[met] = code = len(self.key)
        self.key.append(key)
        self.shape.append(shape)
        self.bits.append(bits)
        return code


def _before(token: str, gap: str, mark: str, closers: str) -> tuple[str, str, int]:
    tail = gap + mark + closers
    traits = [len(token) <= 1, 1 < len(token) <= 3, token[:1].isupper(), token[-1:].isdigit(), "." in token, mark == ".", mark in ("…", "..."), mark[-1] in _NO_SPACE, bool(closers)]
    return _DIGITS.sub("9", token) + tail, _shape(token) + tail, _bits(traits, len(_AFTER_TRAITS))


def _after(token: str, kind: str, opened: bool) -> tuple[str, str, int]:
    key = _DIGITS.sub("9", token) if kind == "word" else token
    shape = _shape(token) if kind == "word" else {"ideograph": "H", "sign": "sign", "none": "-"}[kind]
    nxt = key[:1]
    traits = [nxt.isupper(), nxt.islower(), nxt.isdigit(), opened, kind == "ideograph"]
    return key, shape, _bits(traits, 0) | (0 if kind == "none" else _SOME_AFTER)


def _token_before(text: str, lowest: int, end: int) -> str:
    """The word that ends at ``end``; in scripts without spaces, its last ideograph or what follows it."""
    if _IDEOGRAPH.match(text[end - 1]):
        return text[end - 1]
    size = 40
    while True:
        low = max(lowest, end - size)
        part = text[low:end]
        last = part.split()[-1]
        if not last.isascii():
            last = _IDEOGRAPH.split(last)[-1]
        if len(last) < len(part) or low == lowest:
            return last.lstrip(_OPEN)
        size *= 4


def _token_after(text: str, at: int, stop: int) -> tuple[str, str, bool]:
    """First token from ``at`` on: the token, its kind, whether an opening sign stands before it."""
    i, opened = at, False
    while i < stop:
        c = text[i]
        if c in _OPEN:
            opened = True
        elif not c.isspace():
            break
        i += 1
    else:
        return "", "none", opened
    if c > "\u303f" and _IDEOGRAPH.match(c):
        return text[i : i + 2], "ideograph", opened
    m = _WORD.match(text, i, stop)
    return (m.group(), "word", opened) if m else (c, "sign", opened)


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Parts between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def blocks(text: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """A paragraph's list lines (True), each for itself, and what lies between them."""
    if not (_BULLET.match(text, start, end + 1) or _NUMBER.match(text, start, end + 1) or _LISTED.search(text, start, end + 1)):
        yield start, end, False
        return
    open_at, at, listed = None, start, True
    while at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        is_list = bool(_BULLET.match(text, at, stop + 1)) or (bool(_NUMBER.match(text, at, stop + 1)) and (listed or open_at is None or _ended(text, open_at, at)))
        if is_list:
            if open_at is not None:
                yield open_at, at, False
                open_at = None
            yield at, stop, True
        elif open_at is None:
            open_at = at
        listed = is_list
        at = stop + 1
    if open_at is not None:
        yield open_at, end, False


def _ended(text: str, start: int, end: int) -> bool:
    """Whether what stands before ``end`` ends in a mark or colon, closing signs and white space aside."""
    i = end
    while i > start and text[i - 1].isspace():
        i -= 1
    while i > start and text[i - 1] in _CLOSE:
        i -= 1
    return i > start and (text[i - 1] in _MARKS or text[i - 1] in ":：")


def _inside(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of quotations and brackets that are closed within the block, only the outermost ones, in order."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _QUOTED.finditer(text, start, end):
        i, c = m.start(), m.group()
        if c == '"':
            closes = stack and stack[-1][0] == '"'
        else:
            closes = stack and c == stack[-1][0]
        if closes:
            a = stack.pop()[1]
            while spans and spans[-1][0] > a:
                spans.pop()
            spans.append((a, i))
        elif c == '"':
            stack.append(('"', i))
        elif c in _PAIRS:
            stack.append((_PAIRS[c], i))
    return spans


class Reader:
    """Texts taken apart: pieces (start, end) between possible boundaries, and what is known of the boundary after each."""

    def __init__(self):
        self.before, self.after = _Codes(_before), _Codes(_after)
        self.sizes, self.firsts_sizes = [0], [0]
        self.start, self.end, self.kind, self.b, self.a, self.first = [], [], [], [], [], []

    def read(self, text: str) -> None:
        texts = [(start, end, list(blocks(text, start, end))) for start, end in paragraphs(text)] if text else []
        plain = []  # the marks at the ends of blocks without lists, with what follows them
        for _, _, inner in texts:
            for n, (a, b, listed) in enumerate(inner):
                if listed:
                    self._piece(text, a, b)
                    continue
                first = self.after[_token_after(text, a, b)]
                for at in plain:
                    self.a[at] = first
                plain = self._block(text, a, b)
                if n == 0:
                    self.first.append(first)
        self.sizes.append(len(self.start))
        self.firsts_sizes.append(len(self.first))

    def _piece(self, text: str, s: int, e: int, kind: int = SETTLED, b: int = -1, a: int = -1) -> None:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            self.start.append(s)
            self.end.append(e)
            self.kind.append(kind)
            self.b.append(b)
            self.a.append(a)

    def _block(self, text: str, start: int, end: int) -> list[int]:
        """Pieces of a block; returns the places of its last mark, for what follows it."""
        spans = _inside(text, start, end) if _QUOTED.search(text, start, end) else []
        stop = end
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        gaps = [m.start() for m in _THAI_GAP.finditer(text, start, end)] if _THAI.search(text, start, end) else []
        at, lowest, span, gap, last = start, start, 0, 0, None
        for m in _MARK_RUN.finditer(text, start, stop):
            begin, i = m.span()
            while i < stop:
                c = text[i]
                if c in _CLOSE or (c == "“" and "„" in text[start:i]):
                    i += 1
                elif c.isspace() and i + 1 < stop and text[i + 1] in "»›" and not text[i + 2 : i + 3].isalnum():
                    i += 2
                else:
                    break
            mark = m.group()
            if i < stop and mark[-1] not in _NO_SPACE and not text[i].isspace():
                continue
            while span < len(spans) and spans[span][1] < i:
                span += 1
            if span < len(spans) and spans[span][0] < begin:
                continue
            j = begin
            while j > lowest and text[j - 1].isspace():
                j -= 1
            token = _token_before(text, lowest, j) if j > lowest else ""
            b = self.before[token, " " if j < begin else "", mark, "".join(text[m.end() : i].split()) if i > m.end() else ""]
            follows = _token_after(text, i, stop)
            lowest = i
            if follows[1] == "none":
                last = b
                continue
            while gap < len(gaps) and gaps[gap] < i:
                self._piece(text, at, gaps[gap])
                at = max(at, gaps[gap])
                gap += 1
            settled = gap < len(gaps) and gaps[gap] == i
            gap += settled
            self._piece(text, at, i, MARK | SETTLED * settled, b, self.after[follows])
            at = i
        for g in gaps[gap:]:
            self._piece(text, at, g)
            at = max(at, g)
        if last is None:
            self._piece(text, at, end)
            return []
        self._piece(text, at, end, MARK | LAST | SETTLED, last)
        return [len(self.start) - 1]

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        """One row a document, and the reader is empty again."""
        kind, b, a = np.array(self.kind, np.int32), np.array(self.b, np.int64), np.array(self.a, np.int64)
        known_b, known_a = _Hashed(self.before), _Hashed(self.after)
        bits = np.where(b >= 0, known_b.bits[b], 0) | np.where(a >= 0, known_a.bits[a], 0)
        first, sizes, firsts = np.array(self.first, np.int64), np.array(self.sizes, np.int32), np.array(self.firsts_sizes, np.int32)
        listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(sizes), pa.array(values, kind))
        columns = [
            ids, listed(np.array(self.start, np.int32), pa.int32()), listed(np.array(self.end, np.int32), pa.int32()), listed(kind, pa.int32()), listed(bits.astype(np.int32), pa.int32()),
            *[listed(np.where(codes >= 0, known[codes], 0), pa.int64()) for codes, known in ((b, known_b.key), (b, known_b.shape), (a, known_a.key), (a, known_a.shape))],
            *[pa.ListArray.from_arrays(pa.array(firsts), pa.array(known[first], pa.int64())) for known in (known_a.key, known_a.shape)],
        ]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=["id", "s", "e", "kind", "bits", "kb", "kB", "ka", "kA", "fa", "fA"])


class _Hashed:
    """Hashes and traits by code; an entry more, for the code -1."""

    def __init__(self, codes: _Codes):
        hashed = lambda values, salt: np.append(pd.util.hash_array(np.array(values, dtype=object), hash_key=salt, categorize=False).view(np.int64) if values else np.empty(0, np.int64), 0)
        # tokens and shapes are told apart by the hash key, sides by the column
        self.key, self.shape = hashed(codes.key, "tokens-of-texts."), hashed(codes.shape, "shapes-of-texts.")
        self.bits = np.append(np.array(codes.bits, np.int64), 0)


_READ = "id bigint, s array<int>, e array<int>, kind array<int>, bits array<int>, kb array<bigint>, kB_ array<bigint>, ka array<bigint>, kA_ array<bigint>, fa array<bigint>, fA_ array<bigint>"
#: Texts that are taken apart before a batch is handed on (a text's pieces stay together).
_AT_ONCE = 2_000


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    names = [c.split()[0] for c in _READ.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(at, _AT_ONCE)
            for text in part.column("text").to_pylist():
                reader.read(text)
            yield reader.batch(part.column("id")).rename_columns(names)


def _counted(found: DataFrame) -> DataFrame:
    """(side, key, n, edge) of every token (b, a) and shape (B, A) beside a mark or at the start of a paragraph."""
    c = found.select(F.explode(F.arrays_zip("kind", "kb", "kB_", "ka", "kA_")).alias("c")).select("c.*").filter(F.col("kind").bitwiseAND(MARK) > 0)
    last = (F.col("kind").bitwiseAND(LAST) > 0).cast("int")
    row = lambda side, key, edge: F.struct(F.lit(side).alias("side"), F.col(key).alias("key"), edge.alias("edge"))
    sides = F.when(last == 1, F.array(row("b", "kb", last), row("B", "kB_", last))).otherwise(F.array(row("b", "kb", last), row("B", "kB_", last), row("a", "ka", last), row("A", "kA_", last)))
    inner = c.select(F.explode(sides).alias("r")).select("r.*")
    begin = lambda side, column: found.select(F.lit(side).alias("side"), F.explode(column).alias("key"), F.lit(1).alias("edge"))
    every = inner.unionByName(begin("a", "fa")).unionByName(begin("A", "fA_"))
    return every.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("edge").alias("edge"))


_SIDES = (("b", "kb"), ("B", "kB_"), ("a", "ka"), ("A", "kA_"))


class Held:
    """Statistics held in the worker: counts by side and key."""

    def __init__(self, rows: pd.DataFrame):
        self.by = {}
        for side, _ in _SIDES:
            own = rows[rows["side"] == side].sort_values("key")
            self.by[side] = tuple(own[c].to_numpy(np.int64) for c in ("key", "n", "edge"))

    def counts(self, side: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, n, edge = self.by[side]
        if not len(known):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        there = known[at] == keys
        return np.where(there, n[at], 0), np.where(there, edge[at], 0)


def features(counts: dict[str, tuple[np.ndarray, np.ndarray]], totals: dict[str, tuple[int, int]], bits: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature values of boundaries, and which of them are reliably none.

    ``counts`` has, for the token and the shape of either side, how often it
    was met and how often at the edge of a paragraph.  The boundary's own
    occurrence is left out of them, so a rare token goes by its shape.
    """
    own_edge = ((kind & LAST) > 0).astype(np.int64)

    def others(side: str) -> tuple[np.ndarray, np.ndarray]:
        n, e = counts[side]
        return np.maximum(n - 1, 0), np.maximum(e - own_edge, 0)

    def odds(side: str) -> tuple[np.ndarray, np.ndarray]:
        (n, e), (m, f), (t, g) = others(side), others(side.upper()), totals.get(side.upper(), (0, 0))
        share = np.minimum((f + 2 * (g + 1) / (t + 2)) / (m + 2), 0.95)
        p = np.clip((e + PRIOR * share) / (n + PRIOR), 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p)), (e == 0) & (n * np.log(1 - np.maximum(share, 0.02)) < np.log(CHANCE))

    b, never_b = odds("b")
    a, never_a = odds("a")
    some = (bits & _SOME_AFTER) > 0
    a, never_a = np.where(some, a, 0.0), never_a & some
    traits = [((bits >> i) & 1).astype(float) for i in range(len(_AFTER_TRAITS) + len(_BEFORE_TRAITS))]
    return np.column_stack([np.ones(len(bits)), b / 4, a / 4, np.minimum(b, a) / 4, *traits]), never_b | never_a


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _looked_up(batch: pa.RecordBatch, held: Held | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    if held is not None:
        return {side: held.counts(side, _flat(batch, key)) for side, key in _SIDES}
    return {side: (_flat(batch, f"n_{key}"), _flat(batch, f"e_{key}")) for side, key in _SIDES}


def _labelled(held: Held | None, totals: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, bits = _flat(batch, "kind"), _flat(batch, "bits")
            h = np.repeat(batch.column("h").to_numpy(zero_copy_only=False), np.diff(batch.column("kind").offsets.to_numpy()))
            x, never = features(_looked_up(batch, held), totals, bits, kind)
            last = (kind & LAST) > 0
            keep = ((kind & MARK) > 0) & np.where(last, (bits & _SOME_AFTER) > 0, never)
            width = x.shape[1]
            rows = x[keep]
            sizes = pa.array(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(last[keep].astype(float)), pa.ListArray.from_arrays(sizes, pa.array(rows.ravel()))], names=["h", "y", "x"])

    return run


def _sentences(held: Held | None, totals: dict, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = _flat(batch, "kind")
            x, _ = features(_looked_up(batch, held), totals, _flat(batch, "bits"), kind)
            ends = ((kind & SETTLED) > 0) | (x @ weights > 0)  # the last piece of a block is always settled
            begins = np.append(True, ends[:-1]) if len(ends) else ends
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), np.diff(batch.column("kind").offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[ends]), pa.array(_flat(batch, "s")[begins].astype(np.int64)), pa.array(_flat(batch, "e")[ends].astype(np.int64))], names=["doc_id", "start_pos", "end_pos"])

    return run


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Maximum-entropy weights for two classes (Newton's method, squared penalty), classes weighted alike."""
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    eye = np.eye(x.shape[1]) * penalty / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + eye @ w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + eye
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _joined(found: DataFrame, counts: DataFrame, work: Work) -> DataFrame:
    """``found`` with the counts of every boundary's tokens and shapes as arrays, for statistics that no worker can hold."""
    own = work.put(found.withColumn("_row", F.monotonically_increasing_id()))
    flat = own.select("_row", F.posexplode(F.arrays_zip(*[k for _, k in _SIDES])).alias("_at", "c"))
    flat = flat.select("_row", "_at", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col("c")[k].alias("key")) for s, k in _SIDES])).alias("r")).select("_row", "_at", "r.side", F.concat_ws(":", "r.side", "r.key").alias("k"))
    known = work.put(counts.select(F.concat_ws(":", "side", "key").alias("k"), "n", "edge"))
    hot = hot_keys(known, "k", "n", known.agg(F.sum("n")).first()[0] or 0)
    got = skew_join(flat, known, "k", hot, "left")
    per = got.groupBy("_row", "_at").agg(*[F.max(F.when(F.col("side") == s, F.coalesce(v, F.lit(0)))).alias(f"{p}_{k}") for s, k in _SIDES for p, v in (("n", "n"), ("e", "edge"))])
    names = [f"{p}_{k}" for _, k in _SIDES for p in "ne"]
    rows = per.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", *names))).alias("c"))  # the boundaries of one document
    rows = rows.select("_row", *[F.col("c")[n].alias(n) for n in names])
    none = F.array().cast("array<bigint>")
    return own.join(rows, "_row", "left").withColumns({n: F.coalesce(n, none) for n in names}).drop("_row")


def train(found: DataFrame, counts: DataFrame, held: Held | None, totals: dict) -> np.ndarray:
    """Weights from the bounded sample of reliable boundaries and reliable others."""
    parts = max(1, found.count() // SAMPLE_DOCS)
    sample = found.withColumn("h", F.xxhash64("id", F.lit("sentences"))).filter(F.pmod("h", F.lit(parts)) == 0)
    rows = sample.mapInArrow(_labelled(held, totals), "h bigint, y double, x array<double>").orderBy("h", "y", "x").limit(SAMPLE_ROWS).toPandas()
    if rows["y"].nunique() < 2:
        raise ValueError("the corpus has no reliable boundaries of both kinds to train on; give weights")
    return fit(np.array(rows["x"].tolist()), rows["y"].to_numpy())


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, sent: int = SENT) -> DataFrame:
    """(doc_id, start_pos, end_pos): every sentence of every document, in code points, end exclusive.

    Sentences cover all of the text but white space; null, empty and blank
    texts have none.  A row is handled by itself, so a repeated id gives its
    sentences again.  The classifier is fitted on at most SAMPLE_ROWS labelled
    rows of the corpus itself, or takes ``weights`` (in the order of
    ``features``); its statistics cover all tokens of all documents.  A corpus
    with boundaries to classify but without reliable ones of both kinds needs
    ``weights``: without them it is an error.
    """
    spark = df.sparkSession
    work = Work(spark, "sentences")
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null and length(text) > 0")
    found = work.put(docs.mapInArrow(_read, _READ))
    counts = work.put(_counted(found))
    totals = {r["side"]: (r["n"], r["edge"]) for r in counts.filter("side in ('A', 'B')").groupBy("side").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge")).collect()}
    if counts.limit(sent + 1).count() <= sent:
        held, known = Held(counts.toPandas()), found  # at most ``sent`` rows
    else:
        held, known = None, work.put(_joined(found, counts, work))
    asked = F.exists("kind", lambda k: (k.bitwiseAND(MARK) > 0) & (k.bitwiseAND(SETTLED) == 0))
    if weights is None:
        weights = train(known, counts, held, totals) if not found.filter(asked).isEmpty() else np.zeros(4 + len(_AFTER_TRAITS) + len(_BEFORE_TRAITS))
    return known.mapInArrow(_sentences(held, totals, np.array(weights, float)), "doc_id bigint, start_pos bigint, end_pos bigint")
