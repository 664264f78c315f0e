import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from rivulet.llm import encoding, leakage, sentences
from rivulet.llm.encoding import Encoder, concatenate, encode_corpus, leaves, tokenizer_path
from rivulet.llm.leakage import leaked_items

PARTS = ["water", "'s", "'ll", " ", "  ", "\n", "12", "水井石", "ก้ำ", "...", "--", "é", "<|endoftext|>", "x" * 40, "的" * 30, "7" * 25, "ab" * 20, "!!?", "👩‍🌾", "कुआँ"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder.of(tokenizer_path())


def test_runs_of_bytes(encoder):
    r = random.Random(12)
    for _ in range(300):
        text = "".join(r.choice(["a", "ab", "ing", "the", "water", "é", "水", "zq"]) for _ in range(r.randrange(1, 40)))
        if len(list(encoder.whole.encode_ordinary(text))) and re.fullmatch(r"[a-zé]+", text):
            assert encoder.encode_run(text.encode()) == encoder.encode(text)
    assert encoder.encode_run(b"") == [] and encoder.encode_run(b"\xff\xfe") == [encoder.ranks[b"\xff"], encoder.ranks[b"\xfe"]]
    assert encoder.encode_run(b"a" * 5000) == encoder.encode("a" * 5000)


@pytest.mark.parametrize("leaf", [3, 7, 20])
@pytest.mark.parametrize("reach", [1, 20, 2048])
def test_tree_concatenation_is_exact(encoder, monkeypatch, leaf, reach):
    monkeypatch.setattr(encoding, "REACH", reach)
    monkeypatch.setattr(encoding, "WINDOW", 1)
    r = random.Random(leaf * 100 + reach)
    for i in range(150):
        s = "".join(r.choice(PARTS) for _ in range(r.randrange(1, 40))) if i % 3 else "".join(r.choice("abcdeworst") for _ in range(r.randrange(1, 300)))
        pieces = leaves(s, leaf)
        assert "".join(p for p, _ in pieces) == s
        assert concatenate(encoder, [(p, encoder.encode(p), c) for p, c in pieces]) == encoder.encode(s)


def test_encode_corpus(spark, encoder):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh") for _ in range(3000)) + " and " + "水" * 2500
    texts = ["", None, " ", "hello <|endoftext|> world", long, "a" * 4000, long, "Zürich 12.5 %"]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)] + [(0, "twice", 1, "z")], "doc_id long, text string, row int, ids string")
    got = sorted((x["doc_id"], list(x["ids"])) for x in encode_corpus(df, leaf=500).collect())
    assert got == sorted([(i, encoder.encode(t or "")) for i, t in enumerate(texts)] + [(0, encoder.encode("twice"))])
    assert encode_corpus(df.filter("false")).count() == 0


def test_two_libraries_agree(encoder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for s in ["".join(PARTS), "It's 5 o'clock…\n\n  ok", "", " "]:
        assert t.encode(s, add_special_tokens=False).ids == encoder.encode(s)


def leaks_model(docs, items):
    norm = lambda s: re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", s or "").lower())
    out = set()
    for d, t in docs:
        w, z = norm(t), re.findall("[一-鿿]+", "".join(norm(t)))
        for i, u, lang in items:
            if (lang or "").lower() == "zh":
                pieces = {r[k : k + 20] for r in re.findall("[一-鿿]+", "".join(norm(u))) for k in range(len(r) - 19)}
                hit = any(p in r for p in pieces for r in z)
            else:
                v = norm(u)
                mine = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
                hit = any(tuple(v[k : k + 12]) in mine for k in range(len(v) - 11))
            if hit and d is not None:
                out.add((d, i))
    return out


@pytest.mark.parametrize(("sent", "bits"), [(500_000, 64), (5, leakage.BITS), (5, 64)])
def test_leaks(spark, sent, bits):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(30), "en") for i in range(6)] + [(7, "的水井" * 3 + "慢流向下方旧闸因为没有人封住老暗沟守门" * 2, "ZH"), (8, None, "en"), (9, "", None), (10, text(5), "de"), (11, "Überfluß " + text(14), "de")]
    docs = [(i, text(60)) for i in range(20)]
    for k, n in ((0, 11), (1, 12), (2, 13), (3, 30)):
        w = items[k][1].split()[:n]
        docs.append((100 + k, text(7) + " Zz " + ",\n".join(w).upper() + "! yy " + text(9)))
    zh = items[6][1]
    docs += [(200, "开头，" + "。".join(zh[5:25]) + "x" + text(3)), (201, "开" + zh[5:24] + "尾"), (202, zh[5:15] + "9" + zh[15:30]), (203, unicodedata.normalize("NFD", items[-1][1])), (204, None), (205, ""), (206, text(4000) + " " + items[4][1])]
    docs += [(100, docs[-1][1]), (None, docs[-1][1])]
    d = spark.createDataFrame([(*x, 1, "k") for x in docs], "doc_id long, text string, item_id int, hash string")
    i = spark.createDataFrame(items, "item_id long, text string, lang string")
    got = [tuple(x) for x in leaked_items(d, i, sent=sent, bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == leaks_model(docs, items)
    assert {(101, 1), (103, 3), (200, 7), (203, 11), (206, 4)} <= set(got) and (201, 7) not in set(got)


def test_every_passage_holds_a_minimum():
    """Whatever the size of an item, each of its pieces holds one of its minima; larger partitions take more functions."""
    r = np.random.default_rng(5)
    used = {}
    for n in (8, 9, 20, 40, 100, 300, 1000):
        for repeats in (False, True):
            shingles = leakage._mix(r.integers(1, 40 if repeats else 1 << 60, n).astype(np.uint64))
            windows = np.arange(n - 7)
            minima, functions = leakage.sketch(shingles, windows, 8)
            there = np.isin(shingles, minima)
            assert all(there[w : w + 8].any() for w in windows)
            used[n, repeats] = functions
    assert used[8, False] <= used[40, False] <= used[300, False] < used[1000, False]
    assert leakage.size_partition(8) == 3 and leakage.size_partition(63) == 5 and leakage.size_partition(5000) == 10


def test_long_items_are_several(spark, monkeypatch):
    r = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    long = " ".join(words)
    docs = []
    for k in range(60):
        at = r.randrange(0, 3988)
        docs.append((k, "x " + " ".join(words[at : at + 12]) + " y"))
    docs.append((99, "x " + " ".join(words[100:111]) + " y"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, long, "en")], "item_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in leaked_items(d, i).collect()) == list(range(60))


def test_leaks_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string, lang string")
    assert leaked_items(d, i).count() == 0
    assert leaked_items(d.filter("false"), spark.createDataFrame([(1, "w " * 20, "en")], i.schema)).count() == 0


def corpus():
    """Paragraphs whose sentences are known: (text, sentences)."""
    r = random.Random(8)
    name = lambda: r.choice("BDGKLM") + "".join(r.choice("aeiou") + r.choice("dgklmn") for _ in range(2)) + "a"
    kinds = [
        lambda: f"The pump of {name()} holds 3.5 litres.", lambda: f"Dr. {name()} closed the gate.", lambda: f"It came from Mt. {name()} in winter.", lambda: "They carried rope, wax, etc.",
        lambda: f"“Is it dry?” asked {name()}.", lambda: "Is it safe?", lambda: f"See No. {r.randrange(99)} for details.", lambda: f"She said, “The well is older than {name()}.”", lambda: "(It was never mapped.)",
        lambda: f"They left on day {r.randrange(1, 30)}.", lambda: "水路很长。", lambda: "It slowed... then it stopped.",
    ]
    docs = []
    for _ in range(1500):
        text, known = "", []
        for p in range(r.randrange(1, 4)):
            text += "\n\n" * bool(p)
            for k in range(r.randrange(1, 5)):
                s = r.choice(kinds)()
                text += r.choice([" ", "\n"]) * bool(k)
                known.append((len(text), len(text) + len(s)))
                text += s
        docs.append((text, known))
    return docs


@pytest.mark.parametrize("sent", [sentences.SENT, 10])
def test_sentences_learn_from_the_layout(spark, sent):
    docs = corpus()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    got: dict = {}
    for r in sentences.sentences(df, sent=sent).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    want = {(i, *s) for i, (_, known) in enumerate(docs) for s in known}
    have = {(i, *s) for i, ss in got.items() for s in ss}
    precision, recall = len(want & have) / len(have), len(want & have) / len(want)
    assert precision > 0.98 and recall > 0.98


#: Both sides' log-odds decide.
WEIGHTS = [1.5, 2.0, 1.0, 2.0, 0.5, -2.5, 0.0, 0.5, 0.5, -0.5, 0.0, 0.0, 0.0, 0.0, 0.0, -0.5, 1.0, 0.0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A heading\n\nOne thing", ["A heading", "One thing"]),
        ("- first. item\n2. second | x\nand more text", ["- first. item", "2. second | x", "and more text"]),
        ("คลองยาว 21 กิโลเมตร น้ำใส\nและเย็น", ["คลองยาว 21 กิโลเมตร", "น้ำใส", "และเย็น"]),
        ("  \n\t\n ", []), ("", []), (" ", []), ("...", ["..."]), ("no mark", ["no mark"]),
        ("one\nline goes on", ["one\nline goes on"]), ("Am\n13. tag war es", ["Am\n13. tag war es"]),
        ('<doc id="1" title="A. B">\n\nText', ['<doc id="1" title="A. B">', "Text"]),
    ],
)
def test_layout_rules(text, want):
    reader = sentences.Reader()
    reader.read(text)
    read = reader.batch(pa.array([1])).rename_columns([c.split()[0] for c in sentences._READ.split(", ")])
    held = sentences.Held(pd.DataFrame({"side": [], "key": [], "n": [], "edge": []}))
    (out,) = sentences._sentences(held, {}, np.array(WEIGHTS))(iter([read]))
    assert [text[a:b] for a, b in zip(out.column("start_pos").to_pylist(), out.column("end_pos").to_pylist())] == want


def test_tokens_of_any_length_are_keys():
    reader = sentences.Reader()
    reader.read("a" * 3000 + "b. " + "C" * 3000 + " and on. End")
    assert {len(k) for k in reader.before.key} == {3002, 3} and "C" * 3000 in reader.after.key


def test_a_corpus_without_reliable_boundaries_needs_weights(spark):
    df = spark.createDataFrame([(1, "One. Two"), (2, "no mark"), (3, "")], "doc_id long, text string")
    with pytest.raises(ValueError, match="weights"):
        sentences.sentences(df)
    assert sorted(map(tuple, sentences.sentences(df, weights=WEIGHTS).collect())) == [(1, 0, 4), (1, 5, 8), (2, 0, 7)]
    assert sorted(map(tuple, sentences.sentences(df.filter("doc_id > 1")).collect())) == [(2, 0, 7)]


@pytest.mark.parametrize("sent", [sentences.SENT, 10])
def test_sentences_cover_the_text(spark, sent):
    r = random.Random(2)
    texts = ["".join(r.choice([*PARTS, ". ", "! ", "“", "”", "\n\n", "- ", "。", "(", ")", '"', "« ", " »"]) for _ in range(r.randrange(0, 60))) for _ in range(120)] + [None, "", "a. " * 20_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, id int")
    got: dict = {}
    for x in sentences.sentences(df, weights=WEIGHTS, sent=sent).collect():
        got.setdefault(x["doc_id"], []).append((x["start_pos"], x["end_pos"]))
    for i, t in enumerate(texts):
        spans = sorted(got.get(i, []))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all(t[a:b] == t[a:b].strip() and a < b for a, b in spans)
        assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join((t or "").split())
    assert sentences.sentences(df.filter("false")).count() == 0


def test_fit_separates():
    r = np.random.default_rng(0)
    x = np.c_[np.ones(400), r.normal(size=(400, 2))]
    y = (x[:, 1] + 0.5 * x[:, 2] > 0).astype(float)
    w = sentences.fit(x, y)
    assert ((x @ w > 0) == (y > 0)).mean() > 0.97


def test_item_kind():
    assert leakage.item_kind("zh-CN", "a") == "han" and leakage.item_kind(None, "水井石") == "han" and leakage.item_kind("EN", "水井石") == "words" and leakage.item_kind(None, None) == "words"
