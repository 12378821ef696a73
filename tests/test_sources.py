"""Offsets, markup, files of cases and exact percentiles against plain versions."""

import bisect
import random
import re

import pytest
from oracle import SMALL, of_frame, of_sql
from pyspark.sql import functions as F

from veilframe.operators import metrics, places
from veilframe.plans import queries
from veilframe.sources import corpus


@pytest.mark.parametrize("name", ["tokens_at", "markup_roundtrip", "latency_exact"])
def test_query_equals_its_sql(spark, name):
    assert of_frame(queries.QUERIES[name](spark, SMALL)) == of_sql(queries.ORACLES[name])


def test_places_of_awkward_texts(spark):
    texts = {1: "Дом тут. a.b@c.d\n\nend", 2: "", 3: None, 4: "one", 5: "ok. Слово. x.\n"}
    d = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, offset int")
    want = [(i, o) for i in texts for o in (*range(0, 40), 5000, -1, None)]
    got = {(r.doc_id, r.offset): r for r in places.look_up(d, spark.createDataFrame(want + want[:9], "doc_id long, offset int")).collect()}
    assert set(got) == {(i, o) for i, o in want if o is not None and o >= 0}
    for (i, o), r in got.items():
        raw = (texts[i] or "").encode()
        ends = sorted([m.end() - 1 for m in re.finditer(rb"(?:[A-Za-z]|[\xd0\xd1].){3,}\.", raw, re.S) if not (i == 1 and m.end() > 20)] + [k for k, c in enumerate(raw) if c == 10])
        assert r.sentence == bisect.bisect_left(ends, min(o, len(raw)))
        assert (r.pos is None) == (not raw) and (not raw or r.start_b <= o and (o < r.end_b or o >= len(raw)))
    assert got[1, 17].kind == "word" and got[1, 18].kind == got[1, 21].kind == "email"


def test_markup_and_back(spark):
    r = random.Random(21)
    rows = []
    for i in range(300):
        text = "".join(r.choice(["ab", "Ж", "é", "😀", " ", "\n", "}", "{", "|", "12"]) for _ in range(r.randint(0, 30)))
        rows.append((i, text, [{"start": a, "end": a + r.randint(0, 9), "ty": r.choice(["fio", "x_kpp"])} for a in (r.randint(0, 35) for _ in range(r.randint(0, 5)))]))
    rows += [(900, None, None), (901, "no spans", []), (902, "long " * 50_000 + "end@x", [{"start": 249_999, "end": 250_005, "ty": "email"}])]
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<start:int,end:int,ty:string>>")
    out = df.select("*", corpus.add_markup(F.col("text"), F.col("spans")).alias("c")).select("*", corpus.strip_markup(F.col("c.marked")).alias("b")).collect()
    for x in out:
        text = x.text or ""
        if "{{" in text:
            continue  # has markup of its own, or half of it
        assert x.b.text == text and [(s.start, s.end, s.ty) for s in x.b.spans] == [(s.start, s.end, s.ty) for s in x.c.spans]
        assert all(text.encode()[s.start_b : s.end_b].decode() == text[s.start : s.end] for s in x.c.spans)
        kept, at = [], 0
        for a, z, ty in sorted((s.start, s.end, s.ty) for s in x.spans or ()):
            if a >= at and z <= len(text):
                at = z
                if not re.search(r"\{\{|\}\}|\||\}$", text[a:z]):
                    kept.append((a, z, ty))
        assert [(s.start, s.end, s.ty) for s in x.c.spans] == kept
    assert sum(len(x.c.spans) for x in out) > 150


def test_cases_of_a_split_file_are_read_once(spark, tmp_path):
    """Annotations become a file of cases, which many tasks read; comments, empty texts and odd lines survive."""
    r = random.Random(22)
    rows = [(i, "\n".join(" ".join(r.choice(["слово", "x", "@text", "q@w.e", "end"]) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 4))) + f" t{i}", [{"start": 0, "end": 2, "type": "NAME"}, {"start": 3, "end": 4, "type": "??"}] if i % 3 else None) for i in range(400)]
    rows += [(1000, "line\n@end of it", []), (1001, "has {{fio|x}}", []), (1002, "", []), (1003, "a\r\nb", [])]
    df = spark.createDataFrame(rows, "id long, text string, entities array<struct<start:int,end:int,type:string>>")
    cases = {x.id: x.case for x in corpus.convert(df, {"NAME": "fio"}).collect()}
    assert cases[1000] is None and cases[1001] is None
    for name, some in (("a.txt", [c for i, c in sorted(cases.items()) if c and i % 2]), ("b.txt", [c for i, c in sorted(cases.items()) if c and not i % 2])):
        (tmp_path / name).write_bytes(("# a comment\n# another\n\n" + "\n".join(some) + ("\n@case id=last\n@probes a b  c\n@text\nplain\n@end" if name == "a.txt" else "")).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        loaded = corpus.load(spark, str(tmp_path))
        assert loaded.rdd.getNumPartitions() > 10
        got = {x.id: x for x in loaded.collect()}
        assert loaded.count() == len(got) == len(rows) - 2 + 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for i, text, spans in rows:
        if cases[i] is not None:
            x = got[str(i)]
            marked = [(0, 2, "fio")] if spans and len(text) >= 2 and len(spans) > 1 else []
            assert x.text == text and [(s.start, s.end, s.ty) for s in x.spans] == marked and x.expect == ("mask" if marked else "clean")
    assert (got["last"].text, got["last"].probes, got["last"].size, got["last"].expect) == ("plain", "a b  c", "sentence", "mask")


def test_exact_percentiles_equal_sorting(spark):
    """Also with values that fill a third of a group, null groups and values, groups of one, and ranges of all sizes."""
    r = random.Random(23)
    rows = [(r.choice(["a", "a", "a", None]), 1, r.choice([5.0, r.random() * 10, None])) for _ in range(3000)] + [("one", 2, 7.5), ("none", 3, None), ("same", 4, 1.0), ("same", 4, 1.0)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(7)
    for p in (0, 1, 50, 95, 100):
        want = {}
        for g in {(g, h) for g, h, v in rows if v is not None}:
            values = sorted(v for a, b, v in rows if (a, b) == g and v is not None)
            want[g] = values[p * (len(values) - 1) // 100]
        assert {(x.g, x.h): x[f"p{p}"] for x in metrics.exact_percentile(df, "v", ["g", "h"], p).collect()} == want
    assert metrics.exact_percentile(df.limit(0), "v", ["g"], 50).count() == 0
