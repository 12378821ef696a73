"""Operators whose results SQL can express, on the small tables and on awkward rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from oracle import SMALL, of_frame, of_sql, rows

from veilframe.llm import curriculum, license_scan, queries, rabitq, risk_rules, warc

DOCS = "doc_id long, text string, lang string, source string, size string, level string"
AWKWARD = [
    (1, None, None, None, "s", "l"), (2, "", "en", "a", "s", "l"), (None, "cc by cc by and All rights reserved", "en", None, "s", None), (3, "one two three " * 2000, "de", "b", "s", "l"),
    (3, "one two three " * 2000, "de", "b", "s", "l"), (4, "Ünï!! ### || word\n\nword\nword\n" * 3, "en", "c", "s", "l"), (5, " \t\r\n", "en", "a", "s", "l"), (6, "licensed under the GNU General Public License version 3 " + "x y " * 40, "en", "a", "s", "l"),
]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert of_frame(queries.QUERIES[name](spark, SMALL)) == of_sql(queries.ORACLES[name])


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def test_mix(spark, awkward):
    rows = curriculum.mix(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r.taken <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum(r.taken for r in rows) - total) <= 4
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].target <= 3 * own[0].source_size + 1e-6
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed) and all(0 <= p <= 1 for p in placed)
    assert curriculum.mix(awkward.limit(0)).count() == 0


def test_mix_agrees_in_any_order_of_rows(spark):
    rows = [(None if i % 3 == 0 else i % 7, f"w{i} " * (i % 11 + 1), "ab"[i % 2]) for i in range(60)]
    take = lambda r: sorted((x.doc_id or -1, x["size"], x.text_md5, x.taken) for x in curriculum.mix(spark.createDataFrame(r, "doc_id long, text string, source string")).collect())
    assert take(rows) == take(rows[::-1]) == take(rows[30:] + rows[:30])


def test_scan(spark, awkward):
    rows = {r.doc_id: r for r in license_scan.scan(awkward).collect()}
    r = rows[None]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (8, 3, 0, 5, "cc-by,reserved")
    assert rows[6].base_labels == "gpl" and rows[1].n_words == 0 and rows[1].score == 0
    assert license_scan.scan(awkward.limit(0)).count() == 0


def test_scan_finds_all_notices_of_a_text(spark):
    notice = {label: text for label, _, text in license_scan.TEMPLATES}
    rare = " ".join(["universal charge person binary conditions mozilla dedication unencumbered foundation published gnu cc0"] * 2)
    mpl = " mozilla public license " + notice["mpl-2.0"]
    texts = [notice["mit"] + " and then " + notice["bsd"], rare + " " + notice["isc"], "plain words", None, " and ".join([notice["mit"], notice["bsd"], notice["isc"], mpl]), " . ".join(t for _, _, t in license_scan.TEMPLATES)]
    texts += [word for word in ("license", "software", "licensed", "general") for _ in range(5)] + ["person " * 500 + notice["bsd"] + " software" * 500]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert got[0] == "bsd,mit" and got[1] == "isc" and got[2] == got[3] == "" and got[4] == "bsd,isc,mit,mpl-2.0" and got[26] == "bsd"
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    out = c.execute(license_scan.ORACLE)
    assert of_frame(license_scan.scan(docs)) == rows([x[0] for x in out.description], out.fetchall())
    one = spark.createDataFrame([(1, notice["mit"])], "doc_id long, text string")
    assert license_scan.scan(one).first().labels == "mit"


def test_key_phrases_count_at_the_found_place_only(spark):
    notice = "you may not use this file except in compliance with the license"
    apache = [text for label, _, text in license_scan.TEMPLATES if label == "apache-2.0"]
    assert notice in apache
    zlib = max((text for label, _, text in license_scan.TEMPLATES if label == "zlib"), key=len)
    texts = [notice, "the apache license " + "word " * 300 + notice, apache[0] + " " + notice, zlib, "word " + zlib.replace("plainly", "clearly"), (apache[0] + " and ") * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()}
    assert got[0] == got[1] == ("", 0.0) and got[2][0] == got[5][0] == "apache-2.0" and got[3] == ("zlib", 1.0) and got[4] == ("", 0.0)
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    out = c.execute(license_scan.ORACLE)
    assert of_frame(license_scan.scan(docs)) == rows([x[0] for x in out.description], out.fetchall())


def test_rules(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, None), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in risk_rules.judge(awkward, labels).collect()}
    assert rows[1].base_failed and rows[3].n_repeat_words == 6000 and rows[3].base_failed and not rows[3].kept
    assert risk_rules.judge(awkward.limit(0), labels).count() == 0 and risk_rules.judge(awkward, labels.limit(0)).count() == len(AWKWARD)


def test_rules_reject_where_labels_certify_them(spark):
    """Cutoffs against brute force: two languages, of which one has labels enough."""
    import math
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(6))
    text = lambda kind: " ".join({0: word(), 1: word() + "##", 2: word().upper()}[kind if r.random() < 0.9 else 0] for _ in range(60))
    rows, labels = [], []
    for i in range(1400):
        kind = 0 if i % 10 else 1 + i // 10 % 2
        rows.append((i, text(kind), "en" if i < 1300 else "de", "x"))
        labels.append((i, int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, level string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    m = risk_rules.measure(docs).toPandas()
    m["sound"] = [q for _, q in labels]
    want = {}
    for lang, part in m.groupby("lang"):
        n, p = int(part.sound.sum()), risk_rules.RISK / len(risk_rules.UNITS)
        for rule in risk_rules.UNITS:
            level, best = part["levels"].map(lambda x: x[rule]), None  # noqa: B023
            for cut in sorted(set(level) - {0}, reverse=True):
                k, hit = int(((level >= cut) & (part.sound == 1)).sum()), int(((level >= cut) & (part.sound == 0)).sum())
                tail = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1
                if tail <= risk_rules.CONFIDENCE / (2 * len(risk_rules.UNITS)) and hit > k and (best is None or hit - k > best[0]):
                    best = hit - k, cut
            want[lang, rule] = best and best[1]
    assert want["en", "signs"] and want["en", "capitals"] and not any(v for (lang, _), v in want.items() if lang == "de")
    got = {r.stratum: r for r in risk_rules.choose(risk_rules.measure(docs), marks).collect()}
    assert {("en", k): got["en"][f"cut_{k}"] for k in risk_rules.UNITS} == {k: v for k, v in want.items() if k[0] == "en"} and "de" not in got
    kept = {r.doc_id: r for r in risk_rules.judge(docs, marks).collect()}
    assert {x for r in kept.values() for x in r.failed.split(",")} == {"", "signs", "capitals"}
    assert all(kept[i].kept for i in range(1300, 1400)) and sum(not kept[i].kept for i, q in labels[:1300] if not q) > 120
    assert sum(not kept[i].kept for i, q in labels if q) <= risk_rules.RISK * 1300
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "level"]))
    c.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality"]))
    out = c.execute(risk_rules.ORACLE)
    assert of_frame(risk_rules.judge(docs, marks)) == rows_of(out)


def rows_of(out):
    return rows([x[0] for x in out.description], out.fetchall())


def test_binomial_tail(spark):
    import math

    from pyspark.sql import functions as F

    for k, n, p in ((0, 100, 0.02), (3, 1000, 0.02), (900, 100000, 0.01), (1900, 200000, 0.01), (15, 1000, 0.02), (90, 5000, 0.02)):
        got = spark.range(1).select(risk_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        chance = lambda j: math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))  # noqa: B023, E731
        want = sum(map(chance, range(k + 1))) if k < n * p else 1
        assert abs(got - want) < 1e-8


def test_archives(spark, tmp_path):
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 30
    pages = [(1, "http://a/\r\nx", big, "k"), (2, None, big, "k"), (3, "u", "small", None), (4, "u", "small", None), (None, "u", big, None), (5, "u", None, None), (2, None, big, "k"), (1, "http://b/", big, "k")]
    pages += [(6, "u", "x" * 300, "k"), (6, "u", "x" * 300, "k"), (None, "u", "y" * 300, "k"), (None, "v", "y" * 300, "k"), (7, "u", "z" * (warc.BIG + 10), "k")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, first string")
    warc.write(df, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w")).collect()
    size, none = len(big.encode()), None
    want = [(1, "response", none, size), (1, "revisit", 1, size), (2, "revisit", 1, size), (2, "revisit", 1, size), (none, "revisit", 1, size), (3, "response", none, 5), (4, "response", none, 5), (5, "response", none, 0)]
    want += [(6, "response", none, 300), (6, "revisit", 6, 300), (none, "response", none, 300), (none, "revisit", none, 300), (7, "response", none, warc.BIG + 10)]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_bytes)) for r in back)
    assert {r.payload for r in back if r.record_type == "response" and r.page_id in (1, 7)} == {big, "z" * (warc.BIG + 10)}
    assert {r.url for r in back if r.page_id == 1} == {"http://a/%0D%0Ax", "http://b/"}
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_records_are_gzip_members_of_their_own(spark, tmp_path):
    import gzip
    import zlib

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 3} " * 40) for i in range(9)], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), str(tmp_path / "w"), date="2024-05-06T07:08:09Z")
    ids = set()
    for file in tmp_path.glob("w/part-*"):
        data, at = file.read_bytes(), 0
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == data.count(b"\x1f\x8b\x08")
        while at < len(data):  # each record is read at its own offset
            d = zlib.decompressobj(31)
            head, _, body = d.decompress(data[at:]).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and body.startswith(b"HTTP/1.1 200 OK\r\n") and body.endswith(b"\r\n\r\n") and len(body) == int(fields["Content-Length"]) + 4
            assert fields["Content-Type"] == "application/http; msgtype=response" and ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")
            ids.add(fields["WARC-Record-ID"])
            at = len(data) - len(d.unused_data)
    assert len(ids) == 9


def test_search(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0], "e") for i in range(60)] + [(100, None, "e"), (120, [0.0, 0.0, 0.0], "e"), (140, [float("nan"), 1.0, 1.0], "e"), (160, [None, 1.0, 2.0], "e"), (None, [1.0, 1.0, 1.0], "e"), (180, [1.0, 2.0], "e"), (5, [9.0, 9.0, 9.0], "e"), (7, [8.0, 0.0, 1.0], "e"), (20, [6.0, 2.0, 1.0], "e")]
    got = rabitq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")).collect()
    vectors = {}
    whole = rows[:60] + rows[-3:]
    for i, v, _ in whole:
        vectors[i] = min(vectors.get(i, v), v)
    for q in (0, 20, 40):
        want = sorted(((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v, _ in whole if i != q))[:20]
        assert [(r["rank"], r.vec_id, -r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(n, i, s) for n, (s, i) in enumerate(want, 1)]
    assert {r.query_id for r in got} == {0, 20, 40}


def test_codes_leave_out_most_and_lose_none():
    r = np.random.default_rng(7)
    x = r.standard_normal((12000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, q = np.arange(len(x)), np.arange(0, len(x), 200)
    best = rabitq.Best(ids[q], x[q].astype(float), 20)
    code, scalar, length = rabitq.encode(x.astype(float), rabitq.frame(64))
    asked, near = best.asked, x[q].astype(float) @ x.T
    estimate = asked.estimate(slice(0, len(q)), np.ascontiguousarray(code.T), np.bitwise_count(code).sum(axis=1).astype(np.int64)) * length / scalar
    spread = rabitq.half_widths(scalar, length, asked.dim) / rabitq.WIDTH
    off = (estimate - near) / spread
    assert abs(off.mean()) < 0.02 and 0.9 < off.std() < 1.15  # unbiased, and spread as the bound says
    for i in range(0, len(x), 4000):
        best.meet(ids[i : i + 4000], x[i : i + 4000], code[i : i + 4000], scalar[i : i + 4000], length[i : i + 4000])
    near[np.arange(len(q)), q] = -9
    top = np.argsort(-near, axis=1)[:, :20]
    recall = np.mean([len(set(top[j]) & set(best.found[j][0])) / 20 for j in range(len(q))])
    print(f"recall {recall}, reranked {best.reranked / best.met}")
    assert recall > 0.999 and best.reranked < 0.15 * best.met
