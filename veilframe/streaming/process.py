"""Mask, remember and restore: a keyed state machine as a stream, and its replay as a batch.

The first payload of an id is masked and remembered; the same payload again is masked again; any other payload gets the
original back, or itself where the profile does not allow restoring. An id is forgotten when it has not been used for its
time to live. Originals stand in the state store and in checkpoints: keep those encrypted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe.plans.pipeline import Knowledge, Profile, mask_df

TTL_SECONDS = 900
OUT, MEMORY = "payload_id string, seq long, action string, payload string", "original string, used long, timer long"
#: transformWithState keeps its variables in this store alone.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(requests: DataFrame, demask: bool = True, ttl_seconds: int | None = None) -> DataFrame:
    """requests(payload_id, seq, payload) -> with action (mask, restore or echo) and answer: the text to mask, the original or the payload.

    demask: what the profile says; without it nothing is restored. With ttl_seconds an id is forgotten after so long
    without use, by the timestamps in column at. Windows over each id, in order of seq.
    """
    rows, by_id = requests, Window.partitionBy("payload_id").orderBy("seq")
    spell = Window.partitionBy("payload_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    if ttl_seconds is not None:
        idle = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(by_id) > ttl_seconds * 1_000_000
        rows = rows.withColumn("_new", F.coalesce(idle, F.lit(False)).cast("int")).withColumn("_spell", F.sum("_new").over(spell))
        spell = Window.partitionBy("payload_id", "_spell").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("payload").over(spell)
    again = F.col("payload").eqNullSafe(first)
    action = F.when(again, "mask").otherwise("restore" if demask else "echo")
    return rows.select("payload_id", "seq", "payload", action.alias("action"), (first if demask else F.when(again, first).otherwise(F.col("payload"))).alias("answer"))


class Memory(StatefulProcessor):
    """An id's original, and when it was last used.

    Without an event time the state has a time to live of its own, which every use refreshes. With one, a row that comes
    more than the time to live after the last use begins anew, and a timer that every use sets again clears the state once
    the watermark has passed it. So results do not depend on how rows fall into batches.
    """

    def __init__(self, ttl_seconds: int, demask: bool = True, event_time: str | None = None) -> None:
        self.ttl_ms, self.demask, self.event_time = ttl_seconds * 1000, demask, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", MEMORY, None if self.event_time else self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.memory.get() if self.memory.exists() else None
        timer = held[2] if held else None
        for row in sorted(rows, key=lambda r: r.seq):
            used = int(row[self.event_time].timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            if held is None or (self.event_time and used - held[1] > self.ttl_ms):
                held = (row.payload, used)
            held = (held[0], used)
            if row.payload == held[0]:
                yield Row(payload_id=key[0], seq=row.seq, action="mask", payload=held[0])
            elif self.demask:
                yield Row(payload_id=key[0], seq=row.seq, action="restore", payload=held[0])
            else:
                yield Row(payload_id=key[0], seq=row.seq, action="echo", payload=row.payload)
        if held is None:
            return
        if self.event_time:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = held[1] + self.ttl_ms + 1
            self.handle.registerTimer(timer)
        self.memory.update((held[0], held[1], timer))  # a use refreshes the time to live

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.memory.exists() and self.memory.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.memory.clear()
        return iter(())

    def close(self) -> None:
        pass


def process_stream(requests: DataFrame, ttl_seconds: int = TTL_SECONDS, demask: bool = True, event_time: str | None = None) -> DataFrame:
    """The streaming twin of replay(): requests(payload_id, seq, payload) -> (payload_id, seq, action, payload), the text to mask or the original.

    An id is forgotten ttl_seconds after its last use: by the clock, or by the timestamps of event_time, a column with a
    watermark, as replay() does it. Rows of an id that come in one batch are taken in order of seq. The session's state
    store becomes RocksDB. By the clock, batches without data go on for ever; for availableNow switch those off
    (spark.sql.streaming.noDataMicroBatches.enabled).
    """
    requests.sparkSession.conf.set(*PROVIDER)
    if event_time is None:
        return requests.groupBy("payload_id").transformWithState(Memory(ttl_seconds, demask), OUT, "Append", "ProcessingTime")
    return requests.groupBy("payload_id").transformWithState(Memory(ttl_seconds, demask, event_time), OUT, "Append", "EventTime")


def answer_batch(known: Knowledge, profile: Profile, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: masks what is to be masked and writes payload_id, seq, action, result.

    Each batch has a folder of its own by its number, which a repeated batch writes anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        masked = mask_df(batch.where("action = 'mask'").withColumnRenamed("payload", "text"), known, profile)
        done = masked.select("payload_id", "seq", "action", F.col("masked").alias("result"))
        rest = batch.where("action <> 'mask'").select("payload_id", "seq", "action", F.col("payload").alias("result"))
        done.unionByName(rest).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def counts_by_window(masked: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """masked(ts, ty, ...) -> spans by kind in tumbling windows; rows later than late are left out."""
    return masked.withWatermark("ts", late).groupBy(F.window("ts", width), "ty").count()
