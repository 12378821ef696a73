"""What the engine keeps of texts: segments as bytes, unfolded to tokens where they lie."""

import os
import random

import duckdb
import pytest
from oracle import SMALL, rows
from pyspark.sql import functions as F

from veilframe.operators import lexer, rules
from veilframe.plans import queries
from veilframe.plans.pipeline import Knowledge, mask_df, segments_of, texts
from veilframe.sources import dictionaries


@pytest.fixture(scope="module")
def known(spark):
    return Knowledge(dictionaries.builtin(spark))


def kept_bytes(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_less_is_kept_than_read(spark, known):
    """Texts with a number in every line: everything in them is near an anchor."""
    d = spark.range(2000).select("id", F.concat_ws("\n", *[F.format_string(f"the {i}. boat of %d left the shore at dawn, as 9175550{i:03d} was told", "id") for i in range(3)]).alias("text"))
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))  # a new folder
    masked = mask_df(d, known)
    assert masked.count() == 2000 and kept_bytes(spark) < 6 * d.agg(F.sum(F.octet_length("text"))).first()[0]


def odd_texts():
    r = random.Random(5)
    some = ["слово", "word", "Ab.", "И.", " ", "\n", "  ", "7", "2024", ". ", "-", ",", "a.b@c.org", "x@y@z.example", "@", "é", "☂", "клиент", "Анна", "Москва", "the", "end"]
    return ["".join(r.choice(some) for _ in range(n)) for n in (1, 2, 9, 80, 700, 3000)] + ["", "note " + "a.b-" * 200 + "c@d.org", "end." * 80 + "7", "é" * 400 + " 8 " + "é" * 900 + " 9"]


@pytest.mark.parametrize("damaged", [False, True])
@pytest.mark.parametrize("large", [False, True])
def test_segments_unfold_to_the_tokens_of_their_texts(spark, known, monkeypatch, damaged, large):
    monkeypatch.setattr(lexer, "PIECE_TOKENS", 7)
    if large:
        monkeypatch.setattr(lexer, "MOST_BROADCAST", 10)
    d = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string").repartition(3)
    if damaged:
        b = F.col("text").cast("binary")
        d = d.select("doc_id", F.concat(F.substring(b, F.lit(1), F.octet_length("text").cast("int") - 2), F.unhex(F.lit("D0")), F.substring(b, F.lit(2), F.lit(40)), F.unhex(F.lit("80E2")), b).alias("text"))
    found = segments_of(d.unionByName(d), known)
    got = found.tokens().withColumn("doc_id", F.col("doc_id.id"))
    every = lexer.tokens(d, known.dictionary)
    assert set(got.columns) == set(every.columns) and got.count() > 1000
    assert got.select(every.columns).exceptAll(every).count() == 0
    assert not large or got.count() == every.count()
    text = {r.doc_id: r.text for r in d.collect()}
    for r in found.texts().collect():
        whole = text[r.doc_id["id"]]
        assert whole[r["first"] : r["first"] + len(r.text)] == r.text and r.chars == min(len([c for c in bytes(whole) if c & 0xC0 != 0x80]) if damaged and len(whole) < 256 else len(whole), lexer.SHORT)


def test_rules_shuffle_no_tokens(spark, known):
    found = segments_of(texts(queries.documents(spark, SMALL)), known)
    for hints, rule, _ in rules.PARTS:
        t = rules.context(found.tokens(hints))
        assert "Exchange" not in rule(t, rules.content(t))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["masked_mail", "masked_bytes"])
def test_other_kinds_hide_no_mail(spark, tmp_path, name):
    some = ["Адрес: г. Самара, ул. Тверская, д. 27 q.w@e.org", "звонила Анна Кузнецова.box@post.example тут", "на q.w@e.org и x@y@z", "карта 4029600012345676.a@b.org", None, "", "нет"]
    spark.createDataFrame([(i, t) for i, t in enumerate(some * 5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(queries.ORACLES[name])
    want = rows([x[0] for x in want.description], want.fetchall())
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want
