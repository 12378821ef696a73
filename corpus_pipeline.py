"""A training-data pipeline over documents: STAGES in order, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bagminhash, curriculum, packing, suffix_dedup, weak_quality
from veilframe.llm.common import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier does not reject; the table labels tells it toxic words.

    Rows are judged by text alone: a null or blank text goes, repeated rows stay or go together, null ids do not matter.
    An empty table stays empty.
    """
    return weak_quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id, of rows with one id that of the smaller text hash.

    Texts without words (null, empty) are one class. Of repeated rows one stays. An empty table stays empty.
    """
    found = bagminhash.near_duplicates(docs)
    chosen = found.groupBy("class_k").agg(F.min(F.struct("_k", "_h")).alias("x")).select("x.*", F.lit(True).alias("_stays"))
    rows = docs.select(*COLUMNS).withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = rows.join(chosen, ["_k", "_h"])
    copies = found.groupBy("_k", "_h").count().where("count > 1").take(1)
    return (kept.dropDuplicates(["_k", "_h"]) if copies else kept).select(*COLUMNS)


def cut_copied_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their later copies of passages; n_chars follows.

    Null texts stay null, and rows that repeat an id and text get equal results. All rows stay, also those whose text is
    all copied, as empty texts. An empty table stays empty.
    """
    out = suffix_dedup.remove_copies(docs.select(*COLUMNS))
    return out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("carved.kept"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a copy that the mix cuts is whole if at least half of it is taken.

    Rows that repeat an id, source and text are one document here, with their copies added. Texts without words (null,
    empty) go. Null ids and sources are values like others. An empty table stays empty.
    """
    key = ["doc_id", "source", "text_md5"]
    plan = curriculum.mix(docs.select(*COLUMNS)).where("size > 0").withColumn("_times", F.round(F.try_divide("taken", "size")).cast("int"))
    plan = plan.groupBy(*key).agg(F.sum("_times").alias("_times")).where("_times > 0").withColumnsRenamed({k: f"_{k}" for k in key})
    d = docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    if d.groupBy(*key).count().where("count > 1").take(1):
        d = d.dropDuplicates(key)
    taken = d.join(plan, d.doc_id.eqNullSafe(F.col("_doc_id")) & d.source.eqNullSafe(F.col("_source")) & (F.col("text_md5") == F.col("_text_md5")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048; null texts are empty, each row is packed, an empty table gives no piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("copied_passages", cut_copied_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Trained models, signatures and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
