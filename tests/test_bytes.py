"""Texts of any bytes: the scanner against a plain one, masks outside and inside of spans, and ids that are null or repeat."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.functions import text as X
from veilframe.operators import scanner, spans
from veilframe.plans import queries, written
from veilframe.plans.pipeline import Knowledge, Profile, mask_df
from veilframe.sources import dictionaries

CARD = written.with_luhn("402960001234567")
SPACE = b" \t\n\x0b\f\r"


def plain_units(b):
    """(place, bytes) of each unit: as many as its first byte announces."""
    out, i = [], 0
    while i < len(b):
        c = b[i]
        n = 2 if 0xC0 <= c < 0xE0 else 3 if 0xE0 <= c < 0xF0 else 4 if 0xF0 <= c < 0xF8 else 1
        out.append((i, b[i : i + n]))
        i += n
    return out


def plain_tokens(b):
    """(kind, place, bytes, start) one unit after another."""
    units = plain_units(b)
    letter = lambda u: u[0] in (0xD0, 0xD1) or u[:1].isalpha()
    kind = lambda u: "word" if letter(u) else "digits" if u.isdigit() else "space" if u in (bytes([x]) for x in SPACE) else "sep" if u in (b"-", b"/", b".", b",") else "other"
    mail = lambda u: letter(u) or u.isdigit() or u in (b".", b"-", b"_", b"+")
    out, i = [], 0
    while i < len(units):
        place, u = units[i]
        left, right = i, i + 1
        if u == b"@":
            while left and mail(units[left - 1][1]):
                left -= 1
            while right < len(units) and mail(units[right][1]):
                right += 1
            if left < i and right > i + 1:
                out.append(("email", place, b"".join(x for _, x in units[i:right]), units[left][0]))
                i = right
                continue
            right = i + 1
        k = kind(u)
        if k in ("word", "digits", "space"):
            while right < len(units) and kind(units[right][1]) == k:
                right += 1
        out.append((k, place, b"".join(x for _, x in units[i:right]), place))
        i = right
    return out


def noise(r, n):
    some = [b"a", b"Z", b"q.w", b"7", b"12", b" ", b"\n", b"-", b".", b",", b"@", b"@", b"_", b"+", b"!", b"(", "Ж".encode(), "ё".encode(), "Ђ".encode(), "é".encode(), "—".encode(), "😀".encode(), b"\x00", b"\x01", b"\x01@", b"\x80", b"\xd0", b"\xe2", b"\xf0", b"\xff", b"\xc3"]
    return b"".join(r.choice(some) for _ in range(n))


def test_scanner_equals_a_plain_one():
    r = random.Random(11)
    texts = [noise(r, r.randint(0, 60)) for _ in range(3000)] + ["a@b@c x@ @y z@w. Ёж".encode(), b"", b"\x01@x", b"\xd0"]
    for lo in range(0, len(texts), 40):  # batches, each scanned at once
        batch = texts[lo : lo + 40]
        s = scanner.scan(pa.array([b"other", *batch], pa.binary()).slice(1))
        got = [[] for _ in batch]
        low = s.low.tobytes()
        for d, k, at, n, start in zip(s.doc, s.kind, s.at_b, s.n_b, s.start_b):
            got[d].append((scanner.KINDS[k], int(at - s.bounds[d]), s.data[at : at + n].tobytes(), int(start - s.bounds[d])))
            if k == scanner.WORD and s.valid[d]:
                assert low[at : at + n].decode() == s.data[at : at + n].tobytes().decode().lower().replace("ё", "е")
        assert got == [plain_tokens(t) for t in batch]
        assert [int(s.first_unit[i + 1] - s.first_unit[i]) for i in range(len(batch))] == [len(plain_units(t)) for t in batch]


def test_valid_utf8(spark):
    r = random.Random(12)
    texts = [noise(r, r.randint(0, 12)) for _ in range(1500)] + [b"", "всё".encode(), b"\xf0\x9f\x98"]

    def plain(b):
        return all(len(u) == (2 if 0xC0 <= u[0] < 0xE0 else 3 if 0xE0 <= u[0] < 0xF0 else 4 if 0xF0 <= u[0] < 0xF8 else 1 if u[0] < 0x80 else 9) and all(x & 0xC0 == 0x80 for x in u[1:]) for _, u in plain_units(b))

    df = spark.createDataFrame([(bytearray(t),) for t in texts], "b binary")
    rows = df.select("b", X.valid_utf8(F.col("b")).alias("valid"), X.code_points(F.col("b")).alias("points")).collect()
    assert all(x.valid == plain(bytes(x.b)) and x.points == sum(c & 0xC0 != 0x80 for c in x.b) for x in rows) and {x.valid for x in rows} == {True, False}


SENSITIVE = [f"visa {CARD}", "mail a.b@c.ru", "tel +7 938 200-81-46", "Адрес: г. Самара, ул. Тверская, д. 27", "клиент Анна Кузнецова"]
WANT = ["visa " + "*" * 16, "mail ********", "tel ** *** *********", "Адрес: г. ******, ул. ********, д. **", "клиент **** *********"]


@pytest.fixture(scope="module")
def known(spark):
    return Knowledge(dictionaries.builtin(spark))


def test_control_characters_leave_nothing_open(spark, known):
    """Whatever stands around them, values are masked whole and nothing else changes."""
    r, rows, want = random.Random(13), [], []
    # two Latin words beside a card word are its holder
    fixed = [("\x01@x visa 4029600012345670 ok".replace("4029600012345670", CARD), "\x01@* **** **************** ok"), ("\x01@xy ... mail a.b@c.ru now", "\x01@xy ... mail ******** now")]
    for i in range(150):
        before, after = ("".join(r.choice(["\x00", "\x01", "\x01@", "@", "\x01@x", "\x7f", "é", "😀", " ", "\n"]) for _ in range(r.randint(0, 8))) for _ in range(2))
        k = i % len(SENSITIVE)
        rows.append(f"{before} ! {SENSITIVE[k]} ! {after}")
        want.append(f"{before} ! {WANT[k]} ! {after}")
    rows, want = rows + [a for a, _ in fixed], want + [b for _, b in fixed]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.masked for x in mask_df(d, known).collect()}
    assert [got[i] for i in range(len(rows))] == want
    # the same as bytes, and once more among bytes that are no UTF-8
    around = [(b"\xff\x80 ", b" \xe2\x82"), (b"\xc3 ", b" \xd0"), (b"", b"")]
    data = [(i, bytearray(around[i % 3][0] + t.encode() + around[i % 3][1])) for i, t in enumerate(rows)]
    out = mask_df(spark.createDataFrame(data, "doc_id long, text binary"), known).collect()
    for x in out:
        a, z = around[x.doc_id % 3]
        assert bytes(x.masked) == a + want[x.doc_id].encode() + z
    labels = mask_df(spark.createDataFrame(data[:6] + [(None, None), (-1, bytearray())], "doc_id long, text binary"), known, Profile(mask_mode="token")).collect()
    for x in labels:
        for s in x.spans:
            assert f"[{s.ty}_{s.start}]".encode() in bytes(x.masked)
        assert x.text is not None or x.masked is None


def test_masks_of_bytes(spark):
    """Holes and white space stay, each byte that begins a code point is a star, continuations go."""
    r, rows = random.Random(14), []
    for i in range(300):
        b = noise(r, 40)
        cuts = sorted(r.sample(range(len(b) + 1), 6)) if len(b) > 6 else [0] * 6
        some = [{"start": cuts[0], "end": cuts[3], "ty": "address", "holes": [{"start": cuts[1], "end": cuts[2]}]}, {"start": cuts[4], "end": cuts[5], "ty": "fio", "holes": []}]
        rows.append((b, some))
    out = spans.masked_bytes("stars")(pa.array([b for b, _ in rows], pa.binary()), pa.array([s for _, s in rows])).to_pylist()
    for (b, some), got in zip(rows, out):
        want = b""
        for i in range(len(b)):
            s = next((s for s in some if s["start"] <= i < s["end"]), None)
            if s is None or any(h["start"] <= i < h["end"] for h in s["holes"]) or b[i] in SPACE:
                want += b[i : i + 1]
            elif b[i] & 0xC0 != 0x80:
                want += b"*"
        assert got == want


@pytest.fixture(scope="module")
def own_tables(spark, tmp_path_factory):
    """Documents whose ids are null or repeat, as the registered queries read them."""
    path = str(tmp_path_factory.mktemp("own"))
    rows = [(None, "mail a.b@c.ru now"), (7, "mail a.b@c.ru now"), (7, f"visa {CARD}"), (8, None), (None, "plain words"), (None, f"call and {CARD} then k@m.org"), (9, "mail a.b@c.ru now")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_registered_queries_mask_rows_of_any_ids(spark, own_tables):
    masks = sorted((r.doc_id or -1, r.masked or "", r.n_spans) for r in queries.masked_stars(spark, own_tables).collect())
    hidden = "mail ******** now"
    assert masks == sorted([(-1, hidden, 1), (7, hidden, 1), (7, "visa " + "*" * 16, 1), (8, "", 0), (-1, "plain words", 0), (-1, "call and " + "*" * 16 + " then *******", 2), (9, hidden, 1)])
    assert sorted((r.doc_id or -1, r.ty, r.n) for r in queries.pii_log(spark, own_tables).collect()) == [(-1, "card", 1), (-1, "email", 2), (7, "card", 1), (7, "email", 1), (9, "email", 1)]
    back = queries.envelope_roundtrip(spark, own_tables).collect()
    assert len(back) == 5 and all(r.restored and r.other_system == "cannot open" for r in back)
    found = [(r.doc_id, r.explained.count('"masked"')) for r in queries.explain(spark, own_tables).collect()]
    assert sorted((d or -1, n) for d, n in found) == [(-1, 3), (7, 2), (9, 1)]
    assert queries.phone_candidates(spark, own_tables).count() == 0 and {r.doc_id for r in queries.digit_runs(spark, own_tables).collect()} == {7, None}


@pytest.mark.parametrize("name", ["byte_tokens", "masked_bytes"])
def test_bytes_equal_their_sql(spark, name):
    from oracle import SMALL, of_frame, of_sql

    assert of_frame(queries.QUERIES[name](spark, SMALL)) == of_sql(queries.ORACLES[name])


def test_units_are_code_points_of_valid_texts():
    text = "Ünï 日本 😀 ok"
    s = scanner.scan(pa.array([text.encode()], pa.binary()))
    assert int(s.n.sum()) == len(text) and np.array_equal(s.at_b, np.cumsum(s.n_b) - s.n_b)
