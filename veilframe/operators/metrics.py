"""Latency histograms, percentiles and exposition text as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.folders import shared_folder


def bucket_of(us: Column) -> Column:
    """Half-octave bucket of a count of microseconds: 2 * log2, plus 1 in the upper half."""
    n = F.greatest(us.cast("long"), F.lit(1))
    octave = F.length(F.bin(n)) - 1
    upper = F.when(octave > 0, F.call_function("shiftright", n, octave - 1).bitwiseAND(1)).otherwise(0)
    return F.least(octave * 2 + upper, F.lit(63)).cast("int")


def histogram(df: DataFrame, us: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by, bucket_of(us).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(hist: DataFrame, by: list[str], shares: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The bucket in which each percentile lies: the first whose cumulative count is above floor(p * total / 100)."""
    up = Window.partitionBy(*by).orderBy("bucket")
    h = hist.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy(*by))})
    cells = [F.min(F.when(F.col("upto") > F.floor(F.col("total") * p / 100), F.col("bucket"))).alias(f"p{p}") for p in shares]
    return h.groupBy(*by).agg(F.max("total").alias("total"), *cells)


def exact_percentile(df: DataFrame, value: str, by: list[str], p: int) -> DataFrame:
    """Nearest rank floor(p * (n - 1) / 100), counted from 0, of the values of each group; null values do not count.

    By selection: rows are counted by value first, so repeated values and hot groups shrink where they are; values are
    dealt by range, the totals of the ranges tell in which one a group's rank lies, and only there values are ranked. No
    group is sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    shared_folder(df.sparkSession)
    dealt = counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()).checkpoint()  # ranges are drawn once
    same = lambda a, b, names: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])
    ranges = Window.partitionBy(*by).orderBy("_range")
    totals = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_size"))
    totals = totals.withColumns({"_before": F.sum("_size").over(ranges) - F.col("_size"), "_all": F.sum("_size").over(Window.partitionBy(*by))})
    rank = F.floor(F.lit(p) * (F.col("_all") - 1) / 100)
    one = totals.withColumn("_rank", rank - F.col("_before")).where("_rank >= 0 and _rank < _size")
    there = dealt.alias("d").join(one.alias("o"), same("d", "o", [*by, "_range"])).select(*[F.col(f"d.{c}").alias(c) for c in (*by, value, "_n")], "_rank")
    along = Window.partitionBy(*by).orderBy(value)
    found = there.withColumn("_upto", F.sum("_n").over(along)).where("_rank >= _upto - _n and _rank < _upto")
    return found.select(*by, F.col(value).alias(f"p{p}"))


def exposition(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Text lines name{label="..."} value."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels])
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def mean_and_rate(df: DataFrame, value: str, ts: str, by: list[str]) -> DataFrame:
    """Mean of value, number of rows, and rows a second of the time between the first and the last one."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    seconds = F.greatest(F.lit(1e-6), (F.max(micros) - F.min(micros)) / 1e6)
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"), F.round(F.count("*") / seconds, 6).alias("per_second"))
