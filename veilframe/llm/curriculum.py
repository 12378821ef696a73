"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target share of the mix and a schedule: how strongly it is drawn at each moment of training,
as a piecewise linear function of time in [0, 1]. The integral of the schedule is the source's cumulative demand.
A document stands at a known offset in its source's stream; inverting the demand at that offset gives the time at
which the document is trained on, and a range sort by that time lays out the mix. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import WORD, before, settle, table

#: Relative draw at given times, one schedule for each weight class (taken in turn, as the weights are):
#: the first class fades out, the second is steady, the third comes in late.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.4), (0.6, 1.0), (1.0, 1.9)),
)
WEIGHTS = (1, 2, 3)
MOST = 3


def when_demanded(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches this share (0 to 1) of its total."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, start, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        slope, need = (w1 - w0) / (t1 - t0), share * F.lit(total) - F.lit(start)
        # the positive root of w0 x + slope x^2 / 2 = need, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
        at = F.lit(t0) + F.lit(2.0) * need / (F.lit(w0) + root)
        start += area
        out = F.when(share * F.lit(total) <= F.lit(start), at) if out is None else out.when(share * F.lit(total) <= F.lit(start), at)
    return out.otherwise(F.lit(float(knots[-1][0])))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size), a row for each source -> adds weight, class and target.

    Weights share out the sum of all sizes; a target stops at MOST times its source's size and the excess is
    reshared by weight until no target is above. That is water-filling: with sources in order of cap / weight,
    those before some point sit at their cap and the others get level * weight with one level for all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    s = sizes.withColumn("class", nth).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("class") + 1))
    s = s.withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier, later = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    full = F.col("level").isNull() | (F.col("ratio") <= F.col("level"))
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "class", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """A row for each row of docs(doc_id, text, source, ...), in training order.

    size: words; target: what its source is to give; taken: words of this document that the mix takes, over
    copies copies, the last perhaps cut; position: time of the first copy in [0, 1], null if none is taken;
    positions: of all copies. Within a source documents come in order of the md5 of their id, then of their text
    (text_md5), so reruns agree in any order of rows: only rows equal in both can change places.

    Null text counts no words. A null source is a source of its own, after the others. Documents without words
    take nothing. Repeated rows are documents like others. A null id is read as an empty string. Extra columns
    are ignored. Very long texts are counted whole. An empty table gives an empty result.
    """
    sized = docs.select(
        "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    ).withColumn("_order", F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "text_md5"))
    sized = settle(sized, "sizes")
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    per_source = per_source.withColumnRenamed("source", "_source")
    d = before(sized, ["source"], "_order", "size", "_before")
    d = d.join(per_source, F.col("source").eqNullSafe(F.col("_source")), "left")
    want = F.round("target").cast("long")
    d = d.withColumn("_want", want).withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_want div source_size")).otherwise(0))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_want") - F.col("_whole") * F.col("source_size") - F.col("_before")))
    d = d.withColumn("_rest", F.when(F.col("source_size") > 0, rest).otherwise(0).cast("long"))
    d = d.withColumn("taken", F.col("_whole") * F.col("size") + F.col("_rest"))
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.col("_whole") + (F.col("_rest") > 0).cast("long")).otherwise(0))

    def timed(copy: Column) -> Column:
        share = (copy * F.col("source_size") + F.col("_before")) / F.col("_want")
        out = when_demanded(share, schedules[-1])
        for k in range(len(schedules) - 1):
            out = F.when(F.col("class") == k, when_demanded(share, schedules[k])).otherwise(out)
        return F.round(out, 9)

    d = d.withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), timed)).otherwise(F.array().cast("array<double>")))
    d = d.withColumn("position", F.get("positions", F.lit(0)))
    d = d.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position", "positions", "text_md5")
    return d.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def _demand_sql(share: str, knots: Sequence[tuple[float, float]]) -> str:
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, start, cases = sum(areas), 0.0, ""
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        slope, need = (w1 - w0) / (t1 - t0), f"(({share}) * {total!r}::DOUBLE - {start!r}::DOUBLE)"
        start += area
        cases += f" WHEN ({share}) * {total!r}::DOUBLE <= {start!r}::DOUBLE THEN {t0!r}::DOUBLE + 2 * {need} / ({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {need}, 0)))"
    return f"CASE{cases} ELSE {float(knots[-1][0])!r}::DOUBLE END"


_SHARE = "before_words / want::DOUBLE"
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) || md5(coalesce(text, '')) AS o FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class FROM s0),
s2 AS (SELECT *, class + 1 AS weight, 3 * source_size AS cap, 3 * source_size / (class + 1)::DOUBLE AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM s2),
s4 AS (SELECT *, (SELECT arg_min(lv, ratio) FROM s3 WHERE ratio > lv) AS level FROM s3),
s5 AS (SELECT source, source_size, class, round(CASE WHEN level IS NULL OR ratio <= level THEN cap::DOUBLE ELSE level * weight END, 6) AS target FROM s4),
d0 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_words FROM sized),
d1 AS (SELECT d.*, s.source_size, s.class, s.target, round(s.target)::BIGINT AS want FROM d0 d JOIN s5 s ON d.source IS NOT DISTINCT FROM s.source),
d2 AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS whole FROM d1),
d3 AS (SELECT *, CASE WHEN source_size > 0 THEN greatest(0, least(size, want - whole * source_size - before_words)) ELSE 0 END AS rest FROM d2),
d4 AS (SELECT *, CASE WHEN size > 0 THEN whole + (rest > 0)::BIGINT ELSE 0 END AS copies FROM d3)
SELECT doc_id, size, source_size, target, (whole * size + rest)::BIGINT AS taken, copies::BIGINT AS copies,
       CASE WHEN copies > 0 THEN round(CASE class WHEN 0 THEN {_demand_sql(_SHARE, SCHEDULES[0])}
         WHEN 1 THEN {_demand_sql(_SHARE, SCHEDULES[1])} ELSE {_demand_sql(_SHARE, SCHEDULES[2])} END, 9) END AS position
FROM d4"""
