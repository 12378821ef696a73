"""Dictionaries and profiles that a running stream picks up between batches, without a restart.

A folder holds versions, each complete once its mark is written. Every batch looks for the newest complete version and is
answered under that one alone; what cannot be used (too few words, no profile) is passed over, and the version before stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import metrics
from veilframe.plans.pipeline import Knowledge, Profile, mask_df
from veilframe.sources.dictionaries import LEAST_ENTRIES

_READY = "_READY"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    p, fs = _folder(spark, root)
    if not fs.exists(p):
        return []
    found = [re.fullmatch(r"version=(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
    return sorted(int(m[1]) for m in found if m and fs.exists(_folder(spark, f"{root}/{m[0]}/{_READY}")[0]))


def publish(spark: SparkSession, root: str, dictionary: DataFrame, profiles: dict[str, Profile]) -> int:
    """Write dictionary(folded, flags) and profiles as the next version; nobody sees it before it is complete."""
    number = max(versions(spark, root), default=0) + 1
    at = f"{root}/version={number}"
    dictionary.select("folded", "flags").write.mode("overwrite").parquet(f"{at}/dictionary")
    schema = "system string, enabled boolean, mask_mode string, demask boolean, kinds array<string>, irreversible array<string>"
    rows = [tuple(list(v) if isinstance(v, tuple) else v for v in asdict(p).values()) for p in profiles.values()]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{at}/profiles")
    p, fs = _folder(spark, f"{at}/{_READY}")
    fs.create(p, True).close()
    return number


@dataclass
class Live:
    """The newest usable version below root. It is looked for at each call of current(), and read when it is new."""

    spark: SparkSession
    root: str
    version: int = 0
    known: Knowledge | None = None
    profiles: dict[str, Profile] | None = None

    def current(self) -> tuple[int, Knowledge, dict[str, Profile]]:
        for number in reversed(versions(self.spark, self.root)):
            if number <= self.version:
                break
            at = f"{self.root}/version={number}"
            words = self.spark.read.parquet(f"{at}/dictionary")
            rows = self.spark.read.parquet(f"{at}/profiles").collect()
            if rows and words.limit(LEAST_ENTRIES).count() == LEAST_ENTRIES:
                tuples = {"kinds", "irreversible"}
                made = [Profile(**{f.name: tuple(r[f.name]) if f.name in tuples and r[f.name] is not None else r[f.name] for f in fields(Profile)}) for r in rows]
                self.version, self.known, self.profiles = number, Knowledge(words), {p.system: p for p in made}
                break
        if self.known is None:
            raise ValueError(f"no usable version in {self.root}: nothing would be masked")
        return self.version, self.known, self.profiles


def log_rows(masked: DataFrame) -> DataFrame:
    """masked(payload_id, seq, spans) -> (payload_id, seq, ty, n): what was masked in a request, without values and places."""
    kinds = masked.select("payload_id", "seq", F.explode("spans.ty").alias("ty"))
    return kinds.groupBy("payload_id", "seq", "ty").agg(F.count("*").alias("n"))


def answer_batch(live: Live, path: str, system: str = "default", log: str | None = None, counters: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: masks what is to be masked under the newest version and writes payload_id, seq, action, result, version.

    log: a folder of JSON lines of log_rows(); counters: a folder of requests and masked spans by kind. Both, like the
    answers, have a folder for each batch by its number: a repeated batch writes its own anew, so each counts once. A
    system that the version does not know or that is not enabled gets no answers: its rows have the action denied.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        version, known, profiles = live.current()
        profile = profiles.get(system)
        folder = f"batch_id={batch_id}"
        if profile is None or not profile.enabled:
            denied = batch.select("payload_id", "seq", F.lit("denied").alias("action"), F.lit(None).cast("string").alias("result"), F.lit(version).alias("version"))
            denied.write.mode("overwrite").parquet(f"{path}/{folder}")
            return
        masked = mask_df(batch.where("action = 'mask'").withColumnRenamed("payload", "text"), known, profile)
        rest = batch.where("action <> 'mask'").select("payload_id", "seq", "action", F.col("payload").alias("result"))
        done = masked.select("payload_id", "seq", "action", F.col("masked").alias("result")).unionByName(rest).withColumn("version", F.lit(version))
        done.write.mode("overwrite").parquet(f"{path}/{folder}")
        if log is not None:
            log_rows(masked).write.mode("overwrite").json(f"{log}/{folder}")
        if counters is not None:
            by_kind = log_rows(masked).groupBy(F.lit("masked").alias("name"), F.col("ty").alias("label")).agg(F.sum("n").alias("n"))
            by_action = batch.groupBy(F.lit("requests").alias("name"), F.col("action").alias("label")).agg(F.count("*").alias("n"))
            by_kind.unionByName(by_action).coalesce(1).write.mode("overwrite").parquet(f"{counters}/{folder}")

    return write


def counted(spark: SparkSession, counters: str) -> DataFrame:
    """Totals over all batches that answer_batch() has counted: (name, label, n)."""
    return spark.read.parquet(counters).groupBy("name", "label").agg(F.sum("n").alias("n"))


def exposition(spark: SparkSession, counters: str) -> DataFrame:
    """counted() as text lines."""
    lines = counted(spark, counters)
    return metrics.exposition(lines.select(F.col("label").alias("kind"), "n", "name").where("name = 'masked'"), "masked_total", ["kind"], "n").unionByName(
        metrics.exposition(lines.select(F.col("label").alias("action"), "n", "name").where("name = 'requests'"), "requests_total", ["action"], "n")
    )
