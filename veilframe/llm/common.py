"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space is what the contracts call it: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once: buffers on both sides follow it, whatever the rows' length.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Spark sends to Python workers in this session. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share. Spark removes it when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"  # one machine: every task sees it
    path = f"{base.rstrip('/')}/veilframe-{uuid.uuid4().hex}/{name}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts lineage, and survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(settled: DataFrame) -> None:
    """Remove what settle() wrote, once nothing reads it any more."""
    spark = settled.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(settled.settled_at.rsplit("/", 1)[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: Catalyst would copy a plain alias into every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(df: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add out: the sum of value over the rows of the same group that come earlier by the hex string order.

    A group is split into 4,096 blocks by the first three digits, each summed on its own, so that no group meets
    in one task; only the block totals are summed along the group. df is read twice: settle it first.
    """
    block = F.substring(order, 1, 3)
    df = df.withColumn("_block", block)
    sums = df.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    along = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    df = df.join(sums, same, "left").withColumn(out, F.col("_within") + F.col("_start"))
    return df.drop("_block", "_b", "_start", "_within", *[f"_g_{g}" for g in group])
