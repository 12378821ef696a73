"""Fill-in-the-middle, token counts and the audit of sources against plain versions, with awkward rows."""

import collections
import hashlib
import random
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from veilframe.llm import fill_middle, source_audit, token_counts  # noqa: E402

TEXTS = [
    None, "", "a", "abc def", "Ünï ça va? 日本語 x1y2", "é" * 50 + "word" * 40 + "😀" * 9, "has <M> inside", "x" * 700, "1" * 700, "a<b <P", "<S><", "line\r\n\ttab \x00 nul", "It's 3 o'clock " * 300,
    "end <|endoftext|> of", " lead and trail ", "ab " * 900, "ŠĐ ωμέγα Σ ΑΣ " * 30,
]
SCHEMA = "doc_id long, text string, form string, output string, fim int, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "f", "o", 1, "x") for i, t in enumerate(TEXTS * 6)] + [(None, "null id here " * 3, None, None, None, None), (3, TEXTS[3], "again", "o", 1, "x"), (3, "other text of id 3", "f", "o", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def cut_plainly(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block", [1, 3, 64, fill_middle.BLOCK])
def test_fill_middle_equals_a_plain_one(spark, docs, block):
    d = fill_middle.transform(docs, block=block)
    assert [c for c in d.columns if c != "fim"] == [c for c in docs.columns if c != "fim"]
    out = d.select("doc_id", "text", "fim.*", fill_middle.restored(d.fim.output, d.fim.form).alias("back")).collect()
    assert len(out) == docs.count() and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut_plainly(r.doc_id, r.text) and r.back == (r.text or "")


def test_fill_middle_of_long_texts_and_none(spark):
    r = random.Random(4)
    long = "".join(r.choice(["word", "é", " ", "X", "\n", "日", "7"]) for _ in range(900_000))
    d = spark.createDataFrame([(i, long) for i in range(3)], "doc_id long, text string")
    for x in fill_middle.transform(d).select("doc_id", "fim.*").collect():
        assert tuple(x)[1:] == cut_plainly(x.doc_id, long)
    assert fill_middle.transform(d.limit(0)).count() == 0


def test_every_cut_of_a_tree():
    import numpy as np

    text = "ab1cdé fgh😀ij  klm日本nop"
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    for block in range(1, 40):
        tree = fill_middle.Blocks(np.frombuffer(text.encode(), np.uint8), block)
        assert [tree.cut(k) for k in range(len(units) + 1)] == [(len("".join(units[:k]).encode()), len("".join(units[:k]))) for k in range(len(units) + 1)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, docs, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        whole = lambda t, k=Tokenizer.from_file(path): len(k.encode(t, add_special_tokens=False).ids)
    else:
        from sentencepiece import SentencePieceProcessor

        whole = lambda t, k=SentencePieceProcessor(model_file=path): len(k.encode(t))
    d = docs.unionByName(spark.createDataFrame([(99, " ".join(f"Word{i % 97}, it's é{i}\n" for i in range(9000)), "", "", 1, "")], SCHEMA))
    got = token_counts.count(d, path, limit=100).collect()
    assert len(got) == d.count() and all((r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n := whole(r.text or ""), n > 100) for r in got)
    for piece, group in ((1, 1), (7, 40), (50, 10_000)):
        cut = d.select("text", token_counts.n_tokens(d.text, spark, path, piece, group).alias("n")).collect()
        assert all(r.n == whole(r.text or "") for r in cut)
    assert token_counts.count(d.limit(0), path).count() == 0


def test_pieces_and_groups():
    text = b"one two  three\nfour 5 six"
    cut = token_counts.pieces(text, token_counts._SAFE, 1)
    assert b"".join(cut) == text and cut == [b"one", b" two  three", b"\nfour", b" 5", b" six"]
    sizes = [random.Random(2).randint(0, 50) for _ in range(200)]
    ranges = token_counts.groups(sizes, 300)
    assert [i for lo, hi in ranges for i in range(lo, hi)] == list(range(200)) and max(sum(sizes[lo:hi]) for lo, hi in ranges) < 450
    assert token_counts.groups([], 5) == [] and token_counts.groups([0, 0], 5) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("remembered", [token_counts.REMEMBERED, 1])
def test_repeated_words_go_through_the_library_once(monkeypatch, remembered):
    """Pieces that a task has counted are looked up; with nothing remembered, each batch asks again and the numbers are the same."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "REMEMBERED", remembered)
    path, asked, real = public_tokenizers.path("word_bpe_49k.json"), [], token_counts.lengths_of
    monkeypatch.setattr(token_counts, "lengths_of", lambda *a: (lambda f, *rest: (lambda texts: asked.extend(texts) or f(texts), *rest))(*real(*a)))
    source = type("Source", (), {"value": open(path, "rb").read()})
    count = token_counts.counter(source, True, token_counts.PIECE, token_counts.GROUP)
    texts = ["It's été, the end.  Été\tthe end. <|endoftext|> 日本 语", "", "the end. " * 50, "no_space" * 30]
    whole = Tokenizer.from_file(path)
    want = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [count(pa.array(texts)).to_pylist() for _ in range(3)] == [want] * 3
    assert len(asked) == len(set(asked)) * (1 if remembered > 1 else 3) and sum(map(len, asked)) < 3 * 400


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_add_up_at_every_white_space(name):
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path(name), random.Random(5)
    with open(path, "rb") as f:
        lengths, safe, _ = token_counts.lengths_of(f.read(), True)
    assert safe is token_counts._SAFE_WIDE
    whole = Tokenizer.from_file(path)
    signs = [*" " * 30, *"\n\t" * 4, *"  　\x85\x0b\r\x1cćͅ​́", *map(chr, range(0x21, 0x7F)), *map(chr, range(0xA1, 0x240)), "Σ", "σ", "日", "😀", "<|endoftext|>", "'s", " 're"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        cut = token_counts.pieces(text.encode(), safe, 1)
        assert b"".join(cut) == text.encode() and sum(lengths(cut)) == len(whole.encode(text, add_special_tokens=False).ids)


def audit_plainly(rows, least=3, most=200):
    text = lambda x: "" if x is None else str(x)
    low = lambda w: "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in w)
    n, docs, groups = collections.Counter(), collections.Counter(), set()
    for t, lang, source in rows:
        lang, source = text(lang), text(source)
        groups.add((lang, source))
        terms = [low(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text(t))]
        n.update((lang, source, w) for w in terms)
        docs.update((lang, w) for w in set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), k in docs.items() if g == lang and k >= least]
        sources = sorted(s for g, s in groups if g == lang)
        count = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        p = {s: {w: 1 + 10**9 * (k + 1) // (sum(c.values()) + len(kept)) for w, k in c.items()} for s, c in count.items()}
        all_n = {w: sum(count[s][w] for s in sources) for w in kept}
        q = {w: 1 + 10**9 * (k + 1) // (sum(all_n.values()) + len(kept)) for w, k in all_n.items()}
        for s in sources:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items, top in (("pair", pairs, None), ("term", terms, most)):
                out += [(lang, s, part, w, v, i) for i, (v, w) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    r = random.Random(6)
    words = [r.choice(["", "É", "ж"]) + "".join(r.choice("abcdeXYZ") for _ in range(r.randint(1, 5))) for _ in range(150)] + ["z😀", "_x_", "don't"]
    rows = [(" ".join(r.choice(words[: 20 + 10 * (i % 13)]) for _ in range(r.randint(0, 40))), ["en", "de", None, "fr"][i % 4], ["a", "b", None, "ü", "z"][i * i % 5]) for i in range(160)]
    return rows + rows[:5] + [(None, "en", "empty"), ("", "en", "void"), ("only once", "xx", "p"), ("so rare", "xx", "q"), (None, None, None), (" ".join(words) * 50, "en", "a")]


@pytest.mark.parametrize("bits, most, held, totals, piece", [(64, 200, 300_000, 50_000, 1 << 20), (3, 7, 5, 0, 40), (8, 1, 300_000, 50_000, 200)])
def test_audit_equals_a_plain_one(spark, sourced, monkeypatch, bits, most, held, totals, piece):
    """Also where terms share digests, tasks send on often, totals are joined by shuffles and values tie at the last rank."""
    for name, value in {"MOST_HELD": held, "MOST_TOTALS": totals, "PIECE": piece, "PARTS": 5}.items():
        monkeypatch.setattr(source_audit, name, value)
    df = spark.createDataFrame([(*x, "s", 1) for x in sourced], "text string, lang string, source string, term string, n int")
    got = source_audit.audit(df, most_ranks=most, bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(x) for x in got.collect()) == audit_plainly(sourced, most=most)
    assert source_audit.audit(df.limit(0)).count() == 0


def test_frequencies_of_very_many_words(spark):
    from pyspark.sql import functions as F

    n, total, kept = 9 * 10**13, 9 * 10**15, 10**9
    row = spark.range(1).select(source_audit.frequency(F.lit(n), F.lit(total), F.lit(kept)).alias("p"), source_audit.divergence(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert (row.p, row.f) == (1 + 10**9 * (n + 1) // (total + kept), 10**18)


def test_texts_in_pieces_have_the_same_terms(monkeypatch):
    text = "One two  éclair_three 4 Five6six 日本 " * 7
    for size in range(1, 60):
        monkeypatch.setattr(source_audit, "PIECE", size)
        assert [w for part in source_audit.found(text.encode()) for w in part] == re.findall(source_audit.TERM, text.encode().lower())
