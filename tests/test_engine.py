"""The engine on texts made up for these tests."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import evidence, spans
from veilframe.plans import written
from veilframe.plans.pipeline import Knowledge, Profile, decisions, detect_spans, explain_df, mask_df
from veilframe.sources import corpus, dictionaries
from veilframe.streaming import process

CARD = written.with_luhn("402960001234567")
CASES = {
    "name": ("Наш директор {{fio|Сергей Петрович Сидоров}} в отпуске.", ()),
    "initials": ("сдал отчёт {{fio|Дорофейкин В. Г.}} без правок", ()),
    "passport": ("по словам стража passport {{passport|4718 902316}} найден", ()),
    "phone": ("call {{phone|+7 (938) 200-81-46}} after noon", ()),
    "mail": ("answer to {{email|note.keeper+7@lists.example}} please", ()),
    "card": (f"visa {{{{card|{CARD[:4]} {CARD[4:8]} {CARD[8:12]} {CARD[12:]}}}}} принята", ()),
    "cvv": ("visa с записью cvc {{cvv|808}} на обороте", ()),
    "inn": ("tin {{inn|3628140950}} в бланке", ()),
    "snils": ("insurance {{snils|908-116-302 47}} в бланке", ()),
    "dates": ("born {{birth_date|29.11.1971}} in town", ()),
    "month": ("родилась {{birth_date|17 октября 1964 года}} у моря", ()),
    "order": ("Посылка 60 из 82 в пути", ()),
    "tollfree": ("справки 8 800 219 47 03", ("phone",)),
    "plain": ("Ветер стих, и лодки вышли", ()),
}


@pytest.fixture(scope="module")
def known(spark):
    return Knowledge(dictionaries.builtin(spark))


@pytest.fixture(scope="module")
def cases(spark, known):
    df = spark.createDataFrame([(i, name, text) for i, (name, (text, _)) in enumerate(CASES.items())], "doc_id long, name string, marked string")
    df = df.select("doc_id", "name", corpus.strip_markup(F.col("marked")).alias("b")).select("doc_id", "name", "b.*")
    masked = mask_df(df.select("doc_id", "text"), known).select(F.col("doc_id").alias("_d"), "masked", F.col("spans").alias("found"))
    return {r.name: r for r in df.join(masked, F.col("doc_id") == F.col("_d")).collect()}


@pytest.mark.parametrize("name", [n for n, (_, other) in CASES.items() if not other])
def test_masks_just_what_is_marked(cases, name):
    r = cases[name]
    want = list(r.text)
    for s in r.spans:
        want[s.start : s.end] = [c if c.isspace() else "*" for c in r.text[s.start : s.end]]
    assert r.masked == "".join(want)
    assert [s.ty for s in r.found] == [s.ty for s in r.spans]


def test_stars_keep_the_number_of_characters(cases):
    assert all(len(r.masked) == len(r.text) for r in cases.values())


def test_toll_free_number_from_its_start_is_no_phone(spark, known):
    d = spark.createDataFrame([(1, "звоните 8 804 219 47 03")], "doc_id long, text string")
    assert not decisions(d, known).where("ty = 'phone' and start = 8").count()


def test_address_keeps_markers_and_commas(spark, known):
    d = spark.createDataFrame([(1, "Адрес: г. Самара, ул. Тверская, д. 27, кв. 8")], "doc_id long, text string")
    assert mask_df(d, known).first().masked == "Адрес: г. ******, ул. ********, д. **, кв. *"


def test_modes_profiles_nulls_and_order(spark, known):
    d = spark.createDataFrame([(1, f"на q.w@e.org и {CARD} ок"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    token = {r.doc_id: r.masked for r in mask_df(d, known, Profile(mask_mode="token")).collect()}
    assert token == {1: "на [email_5] и [card_18] ок", 2: None, 3: "", 4: "x"}
    mail = {r.doc_id: r.masked for r in mask_df(d.orderBy(F.desc("doc_id")), known, Profile(kinds=("email",))).collect()}
    assert mail[1] == f"на ********* и {CARD} ок"


def test_explain_tells_codes(spark, known):
    d = spark.createDataFrame([(1, f"карта {CARD} и тел 9175550142")], "doc_id long, text string")
    by = {(r.ty, r.status): r for r in explain_df(d, known).collect()}
    assert set(by[("card", "masked")].codes) >= {"E_CHECKSUM", "E_KW_NEAR"}


def test_null_and_repeated_ids_are_masked(spark, known):
    """Rows are masked by their text: no id leaves one open, and other columns stay."""
    rows = [(None, "mail z.x@y.org now", "a"), (None, None, "b"), (7, "mail z.x@y.org now", "c"), (7, f"visa {CARD}", "d"), (7, "visa", "e"), (None, f"to {CARD} it is, k@m.org", "f")]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string, _row string").withColumn("spans", F.lit(1)).withColumn("_d", F.lit(2))
        got = {r["_row"]: r for r in mask_df(d, known).collect()}
        assert {k: r.masked for k, r in got.items()} == {"a": "mail ********* now", "b": None, "c": "mail ********* now", "d": "visa " + "*" * 16, "e": "visa", "f": "to " + "*" * 16 + " it is, *******"}
        assert all(r["_d"] == 2 for r in got.values())
    found = detect_spans(d, known).collect()
    assert sorted((r.doc_id is None, r.ty) for r in found) == [(False, "card"), (False, "email"), (True, "card"), (True, "email"), (True, "email")]
    assert explain_df(d, known).where("status = 'masked'").count() == 5


def test_masks_in_long_texts_equal_those_in_short_ones(spark, known):
    """Tokens far from any anchor never leave the reader; what is found does not change."""
    filler = "волны шумят у берега и снова тихо " * 60
    parts = ["клиент Анна Кузнецова пришла", f"visa {CARD} тут", "call +7 938 200-81-46 soon", "answer to a.b@lists.example please", "Адрес: г. Самара, ул. Тверская, д. 27!"]
    whole = filler + (" . " + filler).join(parts) + " . " + filler
    alone = {r.doc_id: r.masked for r in mask_df(spark.createDataFrame([(i, "и тут . " + p + " . и там") for i, p in enumerate(parts)], "doc_id long, text string"), known).collect()}
    got = mask_df(spark.createDataFrame([(1, whole)], "doc_id long, text string"), known).first().masked
    assert got == filler + (" . " + filler).join(alone[i][8:-8] for i in range(len(parts))) + " . " + filler and got.count("*") > 60


def test_offices_and_public_persons(spark, known):
    offices = spark.createDataFrame([(f"самараулицатверская{i}",) for i in range(100, 140)], "key string")
    persons = spark.createDataFrame([("кузнецова", "анна кузнецова")], "surname string, form string")
    texts = ["адрес Самара, улица Тверская, 105!", "адрес Самара, улица Тверская, 305!", "клиент Анна Кузнецова тут", "клиент Анна Петрова тут"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {(r.doc_id, r.ty): r for r in explain_df(d, Knowledge(known.dictionary, offices, persons)).where("rule <> 'street_number'").orderBy(F.desc("start_b")).collect()}
    assert "E_ORGADDR" in by[0, "address"].codes and by[0, "address"].status == "rejected" and by[1, "address"].status == "masked"
    assert "E_PUBLIC_FULL" in by[2, "fio"].codes and by[2, "fio"].status == "rejected" and by[3, "fio"].status == "masked"


def test_surnames_of_public_persons_and_mailboxes_of_duties(spark, known):
    from veilframe.functions.types import FLAG

    words = known.dictionary.withColumn("flags", F.when(F.col("folded") == "кузнецова", F.col("flags").bitwiseOR(FLAG["public_person"])).otherwise(F.col("flags")))
    texts = ["звонила Анна Кузнецова тут", "звонила Анна Петрова тут", "на info@q.org и Sales@q.org", "на info.box@q.org тут"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {(r.doc_id, r.ty): r for r in explain_df(d, Knowledge(words, skip_role_mailboxes=True)).collect()}
    assert "E_PUBLIC_SURN" in by[0, "fio"].codes and by[0, "fio"].total == by[1, "fio"].total - 20 and "E_PUBLIC_SURN" not in by[1, "fio"].codes
    assert (2, "email") not in by and by[3, "email"].status == "masked"
    assert explain_df(d, known).where("doc_id = 2 and ty = 'email' and status = 'masked'").count() == 2


def test_counts_by_window(spark):
    import datetime as dt

    at = lambda minute: dt.datetime(2024, 1, 1, 10, minute, tzinfo=dt.timezone.utc)
    d = spark.createDataFrame([(at(0), "fio"), (at(4), "fio"), (at(4), "card"), (at(5), "fio")], "ts timestamp, ty string")
    got = process.counts_by_window(d).select(F.minute("window.start").alias("m"), "ty", "count").collect()
    assert sorted(map(tuple, got)) == [(0, "card", 1), (0, "fio", 2), (5, "fio", 1)]


def test_containment_equals_naive(spark):
    import random

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    inner, outer = {word(r.randint(12, 16)) for _ in range(150)}, {word(r.randint(12, 60)) for _ in range(200)}
    outer |= {word(5) + k + word(3) for k in list(inner)[:40]}
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    got = {tuple(x) for x in evidence.contained(frame(inner), frame(outer)).collect()}
    assert got == {(i, o) for i in inner for o in outer if i in o} and len(got) >= 40


def test_repeated_batches_of_a_stream_write_once(spark, known, tmp_path):
    batch = spark.createDataFrame([("a", 1, "mask", "to q@w.org"), ("a", 2, "restore", "to q@w.org"), ("b", 1, "echo", "x")], "payload_id string, seq long, action string, payload string")
    write = process.answer_batch(known, Profile(), str(tmp_path / "out"))
    for batch_id in (0, 1, 0):
        write(batch, batch_id)
    rows = sorted((r.batch_id, r.payload_id, r.seq, r.result) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [(i, *x) for i in (0, 1) for x in (("a", 1, "to *******"), ("a", 2, "to q@w.org"), ("b", 1, "x"))]


def test_corpus_of_cases(spark, known, tmp_path):
    """Cases from a file: all that is marked is masked and nothing else."""
    body = "".join(f"@case id=c{i} size=sentence polarity=pos expect=mask\n@text\n{text}\n@end\n" for i, (text, other) in enumerate(CASES.values()) if not other)
    (tmp_path / "cases.txt").write_text(body)
    cases = corpus.load(spark, str(tmp_path / "cases.txt"))
    masked = mask_df(cases.select("id", "text", F.col("spans").alias("marked"), "size"), known).select("id", "size", "text", F.col("marked").alias("spans"), "masked")
    assert {r.ty: r.recall for r in corpus.summary(corpus.score(masked)).collect()}.keys() >= {"fio", "card", "phone"}
    assert all(r.recall == 1 for r in corpus.summary(corpus.score(masked)).collect()) and all(r.over == 0 for r in corpus.over_masked(masked).collect())
    assert {(r["size"], r.recall) for r in corpus.summary_by_size(masked).collect()} == {("sentence", 1.0)}


def test_empty_dictionary_is_refused(spark, known):
    d = spark.createDataFrame([(1, "x 1")], "doc_id long, text string")
    with pytest.raises(ValueError):
        mask_df(d, Knowledge(known.dictionary.limit(0)))


def test_no_documents(spark, known):
    assert mask_df(spark.createDataFrame([], "doc_id long, text string"), known).count() == 0


def test_resolution_is_not_stopped_by_dropped_spans(spark):
    rows = [(1, "t", "card", s, e, s, 1, True) for s, e in ((0, 10), (5, 30), (12, 14))]
    d = spark.createDataFrame(rows, "doc_id long, rule string, ty string, start int, end int, start_b int, score int, masked boolean").withColumn("holes", F.array().cast("array<struct<start:int,end:int>>"))
    assert [(s.start, s.end) for s in spans.resolve(d).first().spans] == [(0, 10), (12, 14)]


def test_dictionary_folder(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# names\nАлександр\n\nМарина\n")
    (tmp_path / "keywords.txt").write_text("паспорт passport\nслово nonsense\n")
    (tmp_path / "geox.txt").write_text("\n".join(f"город{'абвгдежзиклмнопрстуфхцчшщыэюя'[i // 10]}{'абвгдежзик'[i % 10]}" for i in range(150)))
    (tmp_path / "public_persons.txt").write_text("Александр Пушкин\tПушкин А. С.\n")
    d = {r.folded: r.flags for r in dictionaries.load(spark, str(tmp_path)).collect()}
    assert d["александром"] == 1 and "слово" not in d and d["пушкина"] & 2 and d["паспорт"] > 0
    (tmp_path / "geox.txt").write_text("один\n")
    with pytest.raises(ValueError):
        dictionaries.load(spark, str(tmp_path))
