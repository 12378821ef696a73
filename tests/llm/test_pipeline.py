import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from veilframe.llm import packing, suffix_dedup  # noqa: E402
from veilframe.llm.common import scratch, settle  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs.toPandas().set_index("doc_id")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        got = out.toPandas()
        if name == "quality":
            assert set(got.doc_id) <= set(first.index) and (got.text == first.loc[got.doc_id].text.values).all()
        if name == "near_duplicates":
            assert got.text.is_unique and got.doc_id.is_unique
        if name == "mix":
            assert got.groupby("doc_id").size().max() <= 3
            words = got.text.str.split().str.len().sum()
        if name == "pack":
            assert got.groupby("sequence_id").length.sum().iloc[:-1].eq(packing.WINDOW).all() and got.length.sum() >= words
        docs = out


def test_awkward_documents(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "a b c d e f " * 40, "en", None, 1), (2, "a b c d e f " * 40, "en", None, 1), (3, "x", "de", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            assert (stage(spark, d, SMALL).count() == 0) or not empty


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """Workers keep memory until they have been idle for a minute: neither two functions in one task, nor rows sent from the driver through workers of their own."""
    rows = [(i, f"{i} " + "the same passage of many words " * 9 + f"{i * i} " * 40, f"s{i % 2}") for i in range(60)]
    docs, plans = spark.createDataFrame(rows, "doc_id long, text string, source string"), []
    docs.write.parquet(at := scratch(spark, "docs"))
    docs = spark.read.parquet(at)
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", 0)
    monkeypatch.setattr(suffix_dedup, "settle", lambda df, name: plans.append(df) or settle(df, name))
    assert suffix_dedup.remove_copies(docs).where("carved.n_removed > 0").count() == 60  # each repeats itself
    plans.append(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))
    assert len(plans) == 4
    for df in plans:
        above = False
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
        for line in plan.splitlines():
            assert not (above and "MapInPandas" in line), plan
            above = "MapInPandas" in line or above and "Project" in line
