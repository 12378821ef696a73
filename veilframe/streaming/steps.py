"""One-time codes as a stream: each step of a caller is accepted once, over batches and restarts.

A code is good for its step of thirty seconds and the ones next to it. A step is accepted if it is later than the last one
accepted of its caller. Where two steps have one code (once in fifty million) the one tried first is meant: the present one,
that before, that after.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe.functions.otp import DIGITS, STEP
from veilframe.functions.text import hmac_sha256
from veilframe.streaming.process import PROVIDER

OUT = "caller string, seq long, step long, accepted boolean"


def code(secret: bytes, step: Column) -> Column:
    """The code of a step, as eight digits. DataFrame functions only: nothing of the secret but its hashes is in the data."""
    mac = F.hex(hmac_sha256(secret, F.unhex(F.lpad(F.hex(step), 16, "0"))))
    at = F.conv(F.substring(mac, 64, 1), 16, 10).cast("int")
    number = F.conv(F.substring(mac, 2 * at + 1, F.lit(8)), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)
    return F.lpad((number % 10**DIGITS).cast("string"), DIGITS, "0")


def claimed(codes: DataFrame, secret: bytes) -> DataFrame:
    """codes(caller, seq, code, at) -> with step: the step near its time whose code it is, null if there is none."""
    now = F.floor(F.unix_seconds("at") / STEP)
    step = F.when(F.col("code") == code(secret, now), now).when(F.col("code") == code(secret, now - 1), now - 1).when(F.col("code") == code(secret, now + 1), now + 1)
    return codes.withColumn("step", step)


def replay(codes: DataFrame, secret: bytes) -> DataFrame:
    """codes(caller, seq, code, at) -> (caller, seq, step, accepted), as a batch.

    The last accepted step is the greatest one claimed so far, so one window tells it. Null callers are one caller.
    """
    before = Window.partitionBy("caller").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    accepted = F.col("step") > F.coalesce(F.max("step").over(before), F.lit(-1))
    return claimed(codes, secret).select("caller", "seq", "step", F.coalesce(accepted, F.lit(False)).alias("accepted"))


class LastStep(StatefulProcessor):
    """The last accepted step of a caller."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "step long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else -1
        for row in sorted(rows, key=lambda r: r.seq):
            accepted = row.step is not None and row.step > last
            last = row.step if accepted else last
            yield Row(caller=key[0], seq=row.seq, step=row.step, accepted=accepted)
        self.last.update((last,))

    def close(self) -> None:
        pass


def verify_stream(codes: DataFrame, secret: bytes) -> DataFrame:
    """The streaming twin of replay(): a code that comes again, in the same batch or a later one, is not accepted.

    Codes are compared before the state is met, so the state sees steps alone. The session's state store becomes RocksDB.
    """
    codes.sparkSession.conf.set(*PROVIDER)
    rows = claimed(codes, secret).select("caller", "seq", "step")
    return rows.groupBy("caller").transformWithState(LastStep(), OUT, "Append", "None")
