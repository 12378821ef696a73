"""Stateful streams against their batch replays: expiry, refreshed uses, codes that come again."""

import datetime as dt
import shutil

import pytest
from oracle import SMALL, of_frame, of_sql
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilframe.functions import otp
from veilframe.plans import queries
from veilframe.streaming import process, steps

BEGIN = dt.datetime(2024, 5, 1, 12, 0, 0, tzinfo=dt.timezone.utc)
SECRET = b"twelve plus bytes"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def stream(spark, tmp_path, batches, schema, build, at=None):
    """Each batch through the same query, stopped and started again between them; rows of all."""
    for i, rows in enumerate(batches):
        part = tmp_path / f"part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in part.glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{i}-{f.name}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        source = source.withWatermark(at, "10 minutes") if at else source
        q = build(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_expiry_by_event_time_equals_replay(spark, tmp_path):
    """A use refreshes the time to live; after it the next payload begins anew, whether in the same batch or a later one."""
    schema = "payload_id string, seq long, payload string, at timestamp"
    row = lambda i, seq, payload, minutes: (i, seq, payload, BEGIN + dt.timedelta(minutes=minutes))
    batches = [
        [row("a", 1, "first", 0), row("a", 2, "masked?", 9), row("b", 1, "one", 0), row("c", 1, None, 0), row("c", 2, "x", 1), row("d", 1, "d1", 0), row("d", 2, "d2", 11)],
        [row("a", 3, "first", 18), row("b", 2, "two", 11), row("d", 3, "d2", 20), row("e", 1, "late", 30)],
        [row("a", 4, "other", 29), row("b", 3, "two", 31), row("c", 3, "x", 31), row("e", 2, "late", 39), row("f", 1, "f", 60)],
        [row("a", 5, "other", 61), row("e", 3, "x", 62), row("f", 2, "g", 65)],
    ]
    got = stream(spark, tmp_path, batches, schema, lambda s: process.process_stream(s, 600, event_time="at"), "at")
    want = process.replay(spark.createDataFrame([r for b in batches for r in b], schema), ttl_seconds=600)
    rows = sorted((r.payload_id, r.seq, r.action, r.payload or "") for r in got.collect())
    assert rows == sorted((r.payload_id, r.seq, r.action, r.answer or "") for r in want.collect())
    assert ("a", 3, "mask", "first") in rows and ("a", 4, "mask", "other") in rows and ("b", 2, "mask", "two") in rows and ("d", 3, "mask", "d2") in rows


def test_time_to_live_by_the_clock(spark, tmp_path):
    """More than a second passes between two runs of the query."""
    schema = "payload_id string, seq long, payload string"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        rows = stream(spark, tmp_path, [[("a", 1, "one")], [("a", 2, "two")]], schema, lambda s: process.process_stream(s, 1)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [(r.seq, r.action, r.payload) for r in rows] == [(1, "mask", "one"), (2, "mask", "two")]


class FakeState:
    """A value state in memory, with its time to live and the writes that refresh it."""

    def __init__(self, ttl):
        self.value, self.ttl, self.writes = None, ttl, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None


def test_uses_by_the_clock_refresh_the_state():
    """Without an event time the state itself has the time to live, and every batch of an id writes it again."""
    machine, states = process.Memory(600), []

    class Handle:
        def getValueState(self, name, schema, ttl):
            states.append(FakeState(ttl))
            return states[0]

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 5

    machine.init(Handle())
    step = lambda *rows: [(r.seq, r.action, r.payload) for r in machine.handleInputRows(("a",), iter([Row(seq=i, payload=p) for i, p in rows]), Clock())]
    assert step((2, "two"), (1, "one")) == [(1, "mask", "one"), (2, "restore", "one")] and step((3, "one")) == [(3, "mask", "one")]
    assert states[0].ttl == 600_000 and states[0].writes == 2 and states[0].value[0] == "one"
    states[0].clear()  # what the store does once the time to live is over
    assert step((4, "two")) == [(4, "mask", "two")]
    silent = process.Memory(600, demask=False)
    silent.init(Handle())
    states[0].value = ("two", 5, None)
    assert [r.payload for r in silent.handleInputRows(("a",), iter([Row(seq=5, payload="x")]), Clock())] == ["x"]


def test_one_code_passes_once(spark, tmp_path):
    """The same code in one batch and in a later one, after a restart: as the verifier on the driver says."""
    schema = "caller string, seq long, code string, at timestamp"
    at = lambda seconds: BEGIN + dt.timedelta(seconds=seconds)
    of = lambda seconds: otp.hotp(SECRET, int(at(seconds).timestamp()) // 30)
    batches = [
        [("x", 1, of(0), at(0)), ("x", 2, of(0), at(5)), ("y", 1, of(30), at(5)), ("x", 3, "00000000", at(6)), (None, 1, of(0), at(0)), ("z", 1, None, at(0))],
        [("x", 4, of(0), at(20)), ("x", 5, of(30), at(31)), ("y", 2, of(0), at(20)), ("x", 6, of(120), at(60)), (None, 2, of(0), at(1))],
    ]
    rows = [r for b in batches for r in b]
    got = sorted((str(r.caller), r.seq, r.accepted) for r in stream(spark, tmp_path, batches, schema, lambda s: steps.verify_stream(s, SECRET)).collect())
    verifier, want = otp.Verifier(SECRET), []
    for caller, seq, code, when in rows:
        want.append((str(caller), seq, verifier.verify(str(caller), code or "", when.timestamp())))
    assert got == sorted(want) and ("x", 1, True) in got and ("x", 2, False) in got and ("x", 4, False) in got
    again = steps.replay(spark.createDataFrame(rows, schema), SECRET)
    assert sorted((str(r.caller), r.seq, r.accepted) for r in again.collect()) == got


def test_codes_equal_those_of_the_driver(spark):
    rows = spark.range(0, 3000, 7).select("id", steps.code(SECRET, F.col("id") * 12345678).alias("code")).collect()
    assert all(r.code == otp.hotp(SECRET, r.id * 12345678) for r in rows)


@pytest.mark.parametrize("name", ["process_expiry", "one_time_steps"])
def test_replays_equal_their_sql(spark, name):
    assert of_frame(queries.QUERIES[name](spark, SMALL)) == of_sql(queries.ORACLES[name])
