"""A running stream that picks up a new dictionary between batches, and its log and counters."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.functions.types import FLAG
from veilframe.plans.pipeline import Profile
from veilframe.sources import dictionaries
from veilframe.streaming import live

SCHEMA = "payload_id string, seq long, action string, payload string"


def test_a_new_word_masks_from_the_next_batch_on(spark, tmp_path):
    root, source, out, log, counters = (str(tmp_path / x) for x in ("versions", "in", "out", "log", "counters"))
    words = dictionaries.builtin(spark)
    assert live.publish(spark, root, words, {"default": Profile(), "shut": Profile("shut", enabled=False)}) == 1
    text = "клиент Дорофея Кузнецова, почта q@w.org"
    rows = [("a", 1, "mask", text), ("a", 2, "restore", "as it was")]
    for i in range(3):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    now = live.Live(spark, root)
    answer = live.answer_batch(now, out, log=log, counters=counters)

    def batch(df, number):
        answer(df, number)
        if number == 0:
            new = spark.createDataFrame([("дорофея", FLAG["name"])], "folded string, flags long")
            assert live.publish(spark, root, words.unionByName(new), {"default": Profile(kinds=("fio",))}) == 2
        if number == 1:  # too few words: the stream stays with what it has
            live.publish(spark, root, words.limit(3), {"default": Profile()})

    q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {(r.batch_id, r.seq): (r.result, r.version) for r in spark.read.parquet(out).collect()}
    first, later = text.replace("q@w.org", "*******"), text.replace("Дорофея Кузнецова", "******* *********")
    assert got[0, 1][1] == 1 and got[0, 1][0].endswith("*******") and got[0, 1][0] != later and first.endswith(got[0, 1][0][-15:])
    assert got[1, 1] == (later, 2) == got[2, 1] and got[1, 2] == ("as it was", 2)

    # the log has kinds and no values; batches that are repeated count once
    lines = [json.loads(x.value) for x in spark.read.text(log).collect()]
    assert {k for x in lines for k in x} == {"payload_id", "seq", "ty", "n"} and len([x for x in lines if x["ty"] == "fio"]) >= 2
    before = sorted(map(tuple, live.counted(spark, counters).collect()))
    answer(spark.createDataFrame(rows, SCHEMA), 2)
    assert sorted(map(tuple, live.counted(spark, counters).collect())) == before and ("requests", "restore", 3) in before and ("masked", "email", 1) in before
    assert 'requests_total{action="mask"} 3' in [x.line for x in live.exposition(spark, counters).collect()]
    assert spark.read.parquet(out).where(F.col("batch_id") == 2).count() == 2

    for system in ("shut", "unknown"):
        live.answer_batch(live.Live(spark, root), f"{out}-{system}", system)(spark.createDataFrame(rows, SCHEMA), 0)
        assert {(r.action, r.result) for r in spark.read.parquet(f"{out}-{system}").collect()} == {("denied", None)}


def test_without_a_version_nothing_is_answered(spark, tmp_path):
    with pytest.raises(ValueError):
        live.Live(spark, str(tmp_path / "none")).current()
    assert live.versions(spark, str(tmp_path / "none")) == []
