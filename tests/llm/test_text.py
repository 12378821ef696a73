"""Packing, classification and extraction: round trips, held-out accuracy and fixtures."""

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from veilframe.llm import packing, template_extract, weak_quality  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [1]


def test_pack_round_trip(spark):
    texts = ["It's 3 o'clock, isn't it? I'd've", "Été über 12½ ÀÉ—“x”…", "ΑΣ σ <|endoftext|> 日本語", None, "", "a " * 5000, "ünï\x00́code  x​y", "word", "İstanbul"]
    rows = [(i % 8, t, f"s{i % 3}" if i % 4 else None, 7) for i, t in enumerate(texts)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string, n long"), PATH).toPandas()
    encode = encoder()
    want = sorted((i, tuple(encode(t))) for i, t, _, _ in rows)
    assert out.length.sum() == sum(len(x) for _, x in want)
    for i, ids in want:
        mine = out[(out.doc_id == i) & (out.doc_tokens == len(ids))].sort_values("start")
        data = np.array(ids, "<u4")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids)
        assert [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    full = out.groupby("sequence_id").length.sum()
    assert (full.iloc[:-1] == packing.WINDOW).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string"), PATH).count() == 0


def test_letters_whose_lower_case_is_elsewhere_keep_their_ids(spark):
    """Ə, Ɛ, Ⱥ and others have a lower case outside the letters that this module splits itself."""
    texts = ["Ə", "Əli və Əhməd", "word Ɛ Ɔ Ŋ word", "ȺȾ", "x" + "".join(map(chr, range(0xA1, 0x250)))]
    texts += [f"a {a}b {a}" for a in map(chr, range(0xA1, 0x250))]
    out = packing.pack(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"), PATH).toPandas()
    encode = encoder()
    for i, mine in out.sort_values("start").groupby("doc_id"):
        ids = np.array(encode(texts[i]), "<u4")
        assert mine.length.sum() == len(ids) and [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    assert out.doc_id.nunique() == len(texts)


def test_each_part_of_words_goes_through_the_model_once():
    """Signs beside a word and later groups of texts do not send it there again."""
    from tokenizers import Tokenizer

    words = packing.WordIds(Tokenizer.from_file(PATH))
    bare, sent = words.bare, []

    class Spy:
        def encode_batch_fast(self, joined, **kwargs):
            sent.extend(joined[0].split())
            return bare.encode_batch_fast(joined, **kwargs)

    words.bare = Spy()
    texts = ["word, word. (word) it's WORD\n", "other word! 22 ", "  ", "", "\t(other) words 2"]
    encode = encoder()
    for group in (texts[:2], texts[2:], texts):
        assert [x.tolist() for x in words.encode(group)] == [encode(t) for t in group]
    assert sorted(sent) == sorted(set(sent)) and {"word", "other", "words"} <= set(sent)


@pytest.mark.parametrize("group, most", [(1, 2), (300, 10), (packing.GROUP, packing.MOST_WORDS)])
def test_ids_do_not_depend_on_groups(monkeypatch, group, most):
    import pandas as pd

    monkeypatch.setattr(packing, "GROUP", group)
    monkeypatch.setattr(packing, "MOST_WORDS", most)
    texts = [" ", "", "Été, it's 12½x", "日本語 word", "word\n\n(word) ß" * 40, "<|endoftext|> a", "Əli", "last."] * 3
    rows = pd.DataFrame({"doc_id": range(len(texts)), "name": "s", "_order": "o", "_t": texts})
    out = pd.concat(packing.tokenised(PATH)(iter([rows[:5], rows[5:5], rows[5:6], rows[6:]])))
    encode = encoder()
    assert out.doc_id.tolist() == rows.doc_id.tolist() and out.n.tolist() == [len(encode(t)) for t in texts]
    assert [packing.grown(x).tolist() for x in out.ids] == [encode(t) for t in texts]
    assert not list(packing.tokenised(PATH)(iter([])))


def test_windows_hold_target_shares(spark, monkeypatch):
    """While all queues last each window has the target shares, then the others share it; the two ways to rank agree."""
    rows = [(i, "one two three four five " * 200, "aabbc"[i % 5], "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, name string")
    of, outs = {i: s for i, _, s, _ in rows}, {}
    for most in (packing.MOST_QUEUES, 1):
        monkeypatch.setattr(packing, "MOST_QUEUES", most)
        for want in (None, {"a": 1, "b": 4, "c": 3}):
            weights = want and spark.createDataFrame(list(want.items()), "source string, weight int")
            out = packing.pack(docs, PATH, weights).toPandas()
            share = {s: w / 8 for s, w in want.items()} if want else {"a": 0.4, "b": 0.4, "c": 0.2}
            early = out.assign(source=out.doc_id.map(of)).pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
            for s in share:
                assert (abs(early[s].iloc[:11] / packing.WINDOW - share[s]) <= packing.PACKET / packing.WINDOW + 1e-9).all()
            if want:  # c ends first, then a and b keep 1 to 4
                dry = early[(early.c == 0) & (early.a > 0) & (early.b > 0)].iloc[1:-1]
                assert len(dry) and (abs(dry.a / packing.WINDOW - 0.2) <= packing.PACKET / packing.WINDOW + 1e-9).all()
            outs[most, bool(want)] = sorted(zip(out.doc_id, out.start, out.length, out.ids_crc32)), early.sum().to_dict()
    for kind in (True, False):
        assert outs[1, kind][1] == outs[512, kind][1] and sum(x[2] for x in outs[1, kind][0]) == sum(x[2] for x in outs[512, kind][0])


def test_repeated_rows_and_any_order_pack_alike(spark):
    rows = [(None if i % 4 == 0 else i % 6, f"word{i % 9} " * 60, "ab"[i % 2]) for i in range(40)]
    pieces = lambda r: sorted(map(str, packing.pack(spark.createDataFrame(r, "doc_id long, text string, source string"), PATH).toPandas().itertuples(index=False)))
    assert pieces(rows) == pieces(rows[::-1])


def test_ranks_are_a_permutation():
    full = np.array([5, 0, 17, 3])
    queue = np.repeat(np.arange(4), full)
    packet = np.concatenate([np.arange(n) for n in full])
    for weight in (np.maximum(full, 1), np.array([1, 1, 9, 2])):
        assert sorted(packing.ranks(queue, packet, full, weight)) == list(range(25))


def test_classifier_on_labels(spark):
    """Labels of even ids tell toxic words; rows with odd ones took no part in anything but the votes' counts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 6000")
    out = weak_quality.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean, poor, toxic = out[(out.quality == 1) & (out.toxic == 0)], out[out.quality == 0], out[(out.quality == 1) & (out.toxic == 1)]
    listed = toxic.text.str.contains("idiot|moron|scum|trash|loser|clown|stupid|pathetic|worthless|disgusting")
    print(f"kept: clean {clean.kept.mean()}, poor {poor.kept.mean()}, toxic {toxic.kept.mean()}, of them in other languages {toxic[~listed].kept.mean()}")
    assert clean.kept.mean() > 0.98 and poor.kept.mean() < 0.05 and toxic.kept.mean() < 0.2 and toxic[~listed].kept.mean() < 0.4
    plain = weak_quality.judge(docs.select("doc_id", "text")).join(labels, "doc_id").toPandas()
    assert plain[(plain.quality == 1) & (plain.toxic == 0)].kept.mean() > 0.98 and plain[plain.quality == 0].kept.mean() < 0.05


def test_features_hold_no_votes():
    """Texts with equal words and measures differ in nothing the scorer sees."""
    a, b = weak_quality.described(["one two three", "one two three"]), weak_quality.described(["three two one"])
    assert (a[0][0] == a[0][1]).all() and (a[0][0] == b[0][0]).all() and (a[1][0] == b[1][0]).all()


def test_measures_equal_plain_ones():
    texts = ["", "  ", "One two TWO two!! a|b # #\nx\n\nx\nx ", "ünï ünï. code", "a" * 3000, "w " * 900]
    got = np.concatenate([t.measures() for _, t in weak_quality.grouped(texts)])
    for t, m in zip(texts, got):
        words, low = t.split(), t.lower().split()
        n = max(len(words), 1)
        lines = [x for x in t.split("\n") if x.strip()]
        want = [len(words), sum(t.count(c) for c in "#*$%&<>{}\\^~=") / n, sum(w[-1] in "#*$%&" for w in words) / n, sum("A" <= c <= "Z" for c in t) / max(1, sum("a" <= c.lower() <= "z" for c in t))]
        want += [sum(a == b and a in "!?" for a, b in zip(t, t[1:])) / n, sum(a == b for a, b in zip(low, low[1:])) / n, len(set(low)) / n, 1 - len({x.lower() for x in lines}) / len(lines) if len(lines) >= 4 else 0]
        want += [t.count("|") / n, sum(len(w) == 1 and not w.isalnum() for w in words) / n, sum(map(t.count, ".!?")) / n, sum(len(w.encode()) for w in words) / n]
        assert np.allclose(m, want)


def test_classifier_on_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "p"), (1, "", "p"), (None, "  \n", "p"), (2, "x", "p"), (3, "word " * 30000, "p"), (3, "word " * 30000, "p")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    for known in (None, labels, labels.limit(0)):
        rows = weak_quality.judge(df, known).collect()
        assert len(rows) == 6 and [r.kept for r in rows if not (r.text or "").strip()] == [False] * 3
        assert weak_quality.judge(df.limit(0), known).count() == 0


PAGE = (
    "<html><head><title>x</title><style>p{{}}</style></head><body><header>Top</header><nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use</div>{main}"
    "<div class='comments'><p>nice</p></div><form>name <input></form><aside>side</aside><footer>&copy; f</footer><script>if (a<b) '</p>'</script></body></html>"
)
ARTICLE = "<article><h1>A &amp; B</h1><p>one <b>two<p>three&nbsp;x<br>y</p><div class=ad>buy</div><ul><li>i<li>j</ul></article>"


def test_main_text():
    text = "A & B\none two\nthree x y\ni\nj"
    alone = lambda page: template_extract.main_text(page, frozenset(), frozenset(), None)
    assert alone(PAGE.format(main=ARTICLE)) == text
    assert alone(PAGE.format(main=ARTICLE.replace("article", "div"))) == text
    assert alone("") == "" and alone("plain <b") == "plain"
    assert alone("<article><p>let <math><mi>x</mi> = 1</math> be</p></article>") == "let x = 1 be"


def story(i, n=30):
    return " ".join(f"{'abcdefghij'[(i * 7 + k * k) % 10]}{(i * k) % 97}" for k in range(n))


def pages_of(spark, pages):
    return spark.createDataFrame([(i, f"http://h.example/{i}", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, host string")


def test_template_decides_in_marked_articles_too(spark, monkeypatch):
    """A notice in every article goes; a line that only some articles share, and a heading on few pages, stay."""
    body = lambda i: f"<h1>t {i}</h1><p>{story(i)}</p>" + ("<p>a shared line</p>" if i % 3 == 0 else "") + ("<h2>References</h2>" if i in (1, 2, 5) else "")
    pages = [f"<body><article>{body(i)}<section><p>Read more on our site every day</p></section></article></body>" for i in range(12)]
    want = {i: "\n".join([f"t {i}", story(i), *["a shared line"] * (i % 3 == 0), *["References"] * (i in (1, 2, 5))]) for i in range(12)}
    assert {r.page_id: r.text for r in template_extract.extract(pages_of(spark, pages)).collect()} == want
    monkeypatch.setattr(template_extract, "LEAST_INSIDE", 1000)
    assert all(r.text.endswith("every day") for r in template_extract.extract(pages_of(spark, pages)).collect())


def test_all_slots_of_an_unmarked_region(spark):
    page = lambda i: f"<body><div>Home of stories</div><div><ul><li><a href=x>{story(i, 9)}</a><li><a href=y>{story(i + 50, 9)}</a></ul></div><div id=c><h1>t {i}</h1><div><p>{story(i, 20)}</p></div><div id=b><p>{story(i + 20, 14)}</p><p>see <a href=z>{story(i + 90, 2)}</a></p></div></div></body>"
    got = {r.page_id: r.text for r in template_extract.extract(pages_of(spark, [page(i) for i in range(8)])).collect()}
    assert got == {i: f"t {i}\n{story(i, 20)}\n{story(i + 20, 14)}\nsee {story(i + 90, 2)}" for i in range(8)}


def texts_of(spark, page, n=12):
    return {r.page_id: r.text for r in template_extract.extract(pages_of(spark, [page(i) for i in range(n)])).collect()}


def test_names_never_empty_an_article(spark):
    """Names inside articles drop neither paragraphs nor varying sections; those of adverts and comments leave the text."""
    alone = lambda page: template_extract.main_text(page, frozenset(), frozenset(), None)
    page = lambda i: f"<body><article><h1>t</h1><p class='side'>{story(i)}</p><div class='print'>{story(i + 30)}</div><div class='ads-box'>buy {story(i + 60, 5)}</div></article></body>"
    want = {i: f"t\n{story(i)}\n{story(i + 30)}" for i in range(4)}
    assert {i: alone(page(i)) for i in range(4)} == want
    got = texts_of(spark, page)
    assert all(got[i].endswith(f"{story(i)}\n{story(i + 30)}") for i in range(12))
    assert alone("<article><h1>t</h1><div class='comments'><p>all there is</p></div></article>") == "t\nall there is"
    assert alone("<article><p>x <span class='search'>y</span> z</p></article>") == "x y z"


def test_named_slots_go_if_they_behave_so(spark):
    """Under a doubtful name a text goes that a fifth of the pages share, and a slot of links; others stay."""
    page = lambda i: f"<body><article><p>{story(i)}</p><div class=notice>{'we are closed' if i % 2 else story(i + 9, 6)}</div><div class=widget><a href=x>{story(i + 50, 5)}</a></div><p class=n{i % 2}>own</p></article></body>"
    got = texts_of(spark, page)
    for i in range(12):
        assert "we are closed" not in got[i] and story(i + 50, 5) not in got[i] and story(i) in got[i]
        assert i % 2 or story(i + 9, 6) in got[i]


def test_leads_and_intros_stay(spark):
    """A short lead beside a long body, and a heading and an intro beside the article of a main part."""
    lead = lambda i: f"<body><div class=top>Our site</div><div class=lead>{story(i + 40, 8)}</div><div class=body><p>{story(i, 400)}</p></div></body>"
    assert texts_of(spark, lead) == {i: f"{story(i + 40, 8)}\n{story(i, 400)}" for i in range(12)}
    intro = lambda i: f"<body><div>{story(i + 70, 6)}</div><main><h2>head {i}</h2><div class=intro>{story(i + 40, 8)}</div><article><p>{story(i, 200)}</p></article></main></body>"
    assert texts_of(spark, intro) == {i: f"head {i}\n{story(i + 40, 8)}\n{story(i, 200)}" for i in range(12)}


def test_notices_of_sections(spark):
    """Each of two sections has its notice in all its articles; a heading that half of the articles share stays."""
    page = lambda i: f"<body><article class={'ab'[i % 2]}><h1>t {i}</h1><p>{story(i)}</p>{'<h2>Sources</h2>' if i % 4 < 2 else ''}<p>{['Sport every day', 'News at nine'][i % 2]}</p></article></body>"
    assert texts_of(spark, page, 16) == {i: f"t {i}\n{story(i)}" + "\nSources" * (i % 4 < 2) for i in range(16)}


def test_links_beside_text_stay(spark):
    """A list of sources in the text's container stays; a menu of links in its own goes."""
    page = lambda i: f"<body><div class=top><ul><li><a href=a>{story(i + 80, 3)}</a></ul></div><div class=c><p>{story(i)}</p><ul><li><a href=x>{story(i + 20, 4)}</a><li><a href=y>{story(i + 33, 4)}</a></ul></div></body>"
    assert texts_of(spark, page) == {i: f"{story(i)}\n{story(i + 20, 4)}\n{story(i + 33, 4)}" for i in range(12)}


def test_copies_of_a_page_are_no_template(spark):
    pages = [f"<article><h1>one</h1><p>{story(1)}</p></article>"] * 9 + [f"<article><h1>two</h1><p>{story(2)}</p></article>"]
    got = template_extract.extract(pages_of(spark, pages)).collect()
    assert all(r.text == (f"one\n{story(1)}" if r.page_id < 9 else f"two\n{story(2)}") for r in got)


def test_classes_equal_brute_force(spark):
    """Equivalence classes from exact occurrence vectors."""
    pages = [f"<body><div>menu</div><div class=x>{'note' if i % 2 else f'own {i}'}</div><p>{story(i)}</p><p>{'twice' if i < 5 else i}</p><footer>end</footer></body>" for i in range(10)]
    vectors, kinds = {}, {}
    for i, source in enumerate(pages):
        blocks, paths = template_extract.blocks_of(source)
        for t in paths + [f"{b[0]}\x1f{b[1]}" for b in blocks]:
            vectors.setdefault(t, {}).setdefault(i, 0)
            vectors[t][i] += 1
            kinds[t] = "\x1f" in t
    groups = {}
    for t, v in vectors.items():
        if len(v) >= template_extract.LEAST_PAGES:
            groups.setdefault(tuple(sorted(v.items())), []).append(t)
    want = {t for g in groups.values() if not all(kinds[t] for t in g) for t in g if kinds[t]}
    assert {t.split("\x1f")[1] for t in want} == {"menu", "end"}
    rows = pages_of(spark, pages).selectExpr("xxhash64(html) AS uid", "'h' AS host", "xxhash64(html) AS page", "html")
    assert sorted(template_extract.templates(rows).first().texts) == sorted(template_extract._hash(sorted(want)))


def test_awkward_pages(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>All offers on one page</div><div id=c><p>story {i} {'abc'[i % 3] * 30}</p></div></body>", "x") for i in range(9)]
    rows += [(None, None, None, "x"), (3, rows[3][1], rows[3][2], "x"), (70, "bad", "<p>" + "long " * 50000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, region string")
    out = template_extract.extract(df).collect()
    assert len(out) == len(rows)
    for r in out:
        want = "" if r.page_id is None else " ".join(["long"] * 50000) if r.page_id == 70 else f"story {r.page_id} {'abc'[r.page_id % 3] * 30}"
        assert r.text == want and r.n_chars == len(want)
    assert template_extract.extract(df.limit(0)).count() == 0


def test_given_pages_keep_their_articles(spark):
    """On the given pages the article is the main text, whatever the host's template is."""
    import html
    import re

    for r in spark.read.parquet(f"{SMALL}/pages.parquet").join(template_extract.op8_template_extract(spark, SMALL), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:h1|p)>", body))
        assert r.text == "\n".join(p for p in parts if p)
