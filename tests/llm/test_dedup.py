"""Copies and near copies against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest

from veilframe.llm import bagminhash, suffix_dedup

SCHEMA = "doc_id long, text string, key string"


def words(n, seed, letters="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    shared, base = words(40, 1), words(120, 2)
    r = random.Random(3)
    near = lambda k: " ".join(w if r.random() > k else "zzz" for w in base.split())
    texts = [words(80, 10 + i) + " " + shared + " " + words(30, 50 + i) for i in range(8)] + [base] + [near(0.01) for _ in range(8)] + [near(0.2) for _ in range(3)]
    texts += ["a b c", "a b c", None, "", "   ", "ü" * 300, "the same line\n" * 40, words(3000, 99), base, base]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return rows + [(None, base, None), (5, texts[5], "again")]


def removed(rows):
    """Straight from the definition, with sets of windows."""
    seen, out = set(), {}
    for k, t in sorted({(2**63 - 1 if i is None else i, t) for i, t, _ in rows}, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[k] = len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("kinds", [4096, 3])
def test_suffix_dedup_equals_definition(spark, docs, monkeypatch, kinds):
    """With 3, the passage that eight documents share is dealt on by its windows."""
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", kinds)
    monkeypatch.setattr(suffix_dedup, "HOT", 32 if kinds > 3 else 6)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3).selectExpr("*", "key AS _k", "1 AS _runs", "2 AS carved", "3 AS _h")
    assert (len(suffix_dedup.hot_anchors(suffix_dedup.keyed(frame))) > 0) == (kinds == 3)
    out = suffix_dedup.remove_copies(frame).select("doc_id", "key", "_k", "_runs", "carved.*").collect()
    want = removed(docs)
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[2**63 - 1 if r.doc_id is None else r.doc_id]


def test_longest_previous_factors_equal_brute_force(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LENGTH", 12)
    r = np.random.default_rng(5)
    for letters in (1, 2, 3):
        data = r.integers(97, 97 + letters, 160).astype(np.uint8)
        starts = np.arange(len(data) - 11)
        suffix = np.lib.stride_tricks.sliding_window_view(data, 12)[starts]
        got = suffix_dedup.longest_previous(suffix)
        common = lambda a, b: next((i for i in range(12) if a[i] != b[i]), 12)
        want = [max((common(suffix[i], suffix[j]) for j in range(i)), default=0) for i in range(len(starts))]
        assert got.tolist() == want
        hit = suffix_dedup.earlier_matches(data, starts, suffix_dedup.Powers())
        assert hit.tolist() == [w >= 12 for w in want]


def test_smaller_before():
    r = np.random.default_rng(6)
    for _ in range(20):
        x = r.permutation(50)
        assert suffix_dedup.smaller_before(x).tolist() == [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(50)]


def test_long_texts_in_pieces(monkeypatch):
    """Pieces of one text overlap so that no window is lost."""
    import pandas as pd

    text = words(400, 5)
    frame = pd.DataFrame({"_k": [1], "_h": [2], "_t": [text]})
    whole = pd.concat(suffix_dedup.stretches(iter([frame])))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    parts = pd.concat(suffix_dedup.stretches(iter([frame])))
    windows = lambda d: sorted(p + i for p, c in zip(d["pos"], d["cnt"]) for i in range(c))
    assert windows(whole) == windows(parts) == list(range(len(text.encode()) - 99))


def bag(t):
    w = (t or "").split()
    k = min(5, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def classes(rows):
    bags, root = [bag(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both, all_ = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
        if both >= 0.8 * all_:
            root[find(j)] = find(i)
    return {frozenset(i for i in range(len(rows)) if find(i) == c) for c in map(find, range(len(rows)))}


def test_near_duplicate_classes(spark, docs):
    rows = [(i, t, k) for i, (_, t, k) in enumerate(docs)]
    got = collections.defaultdict(set)
    for r in bagminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.class_k].add(r["_k"])
    assert set(map(frozenset, got.values())) == classes(rows)
    assert all(k == min(v) for k, v in got.items())


def test_copies_that_only_meet_through_their_original(spark):
    base, r = words(200, 5).split(), random.Random(6)
    star = [" ".join(w if r.random() > 0.02 else words(1, 1000 * k + i) for i, w in enumerate(base)) for k in range(240)]
    star[120] = " ".join(base)
    other = words(200, 7).split()
    star += [" ".join(base[: 5 * k] + other[5 * k :]) for k in range(1, 40)]
    rows = [(i, t, "x") for i, t in enumerate(star)]
    got = collections.defaultdict(set)
    for r in bagminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.class_k].add(r["_k"])
    assert set(map(frozenset, got.values())) == classes(rows)


@pytest.mark.parametrize("block", [4096, 16])
def test_no_link_is_lost_in_a_bucket_of_many_clusters(spark, monkeypatch, block):
    """60 clusters that all meet in the buckets of what they share, and no hub that links them."""
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    common, r, rows = words(100, 1).split(), random.Random(2), []
    for c in range(60):
        own = words(60, 100 + c).split()
        for k in range(4):
            w = common + own
            for _ in range(k):
                w[r.randrange(len(w))] = f"x{c}y{k}"
            rows.append((len(rows), " ".join(w), "x"))
    r.shuffle(rows)
    got = collections.defaultdict(set)
    for x in bagminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect():
        got[x.class_k].add(x["_k"])
    texts = dict((i, t) for i, t, _ in rows)
    want = {frozenset(sorted(c)) for c in classes([(i, texts[i], "") for i in range(len(rows))])}
    mine = {x: k for k, v in got.items() for x in v}
    links = [(a, b) for c in want for a, b in itertools.combinations(sorted(c), 2)]
    print("recall of pairs in one class", sum(mine[a] == mine[b] for a, b in links) / len(links))
    assert len(want) > 30 and set(map(frozenset, got.values())) == want


def test_sketches_rule_out_no_similar_pair():
    r, lost = np.random.default_rng(3), 0
    for _ in range(300):
        items = r.integers(1, 2**63, 250).astype(np.uint64)
        a, b = items[:225], items[25:]  # similarity 0.8
        sign = lambda x: (bagminhash.mix64(bagminhash.bag_signature(x, np.ones(len(x), np.int64), 160).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
        lost += (sign(a) == sign(b)).sum() < bagminhash.AGREE
    assert lost == 0


def test_signature_is_unbiased():
    r = np.random.default_rng(1)
    items = r.integers(1, 2**63, 400).astype(np.uint64)
    a, b = r.integers(0, 9, 400), r.integers(0, 9, 400)
    b[:250] = a[:250]
    sign = lambda c: bagminhash.bag_signature(items[c > 0], c[c > 0], 4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign(a) == sign(b)).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4096)


@pytest.mark.parametrize("run", [suffix_dedup.remove_copies, bagminhash.near_duplicates])
def test_no_documents(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
