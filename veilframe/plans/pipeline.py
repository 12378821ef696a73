"""The whole way from texts to masked texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.folders import shared_folder
from veilframe.operators import evidence, rules, spans
from veilframe.operators.lexer import Segments, segments


@dataclass(frozen=True)
class Profile:
    """What a consuming system gets: kinds (None: all), stars or token mode, kinds that cannot be restored."""

    system: str = "default"
    enabled: bool = True
    mask_mode: str = "stars"
    demask: bool = True
    kinds: tuple[str, ...] | None = None
    irreversible: tuple[str, ...] = ()


@dataclass(frozen=True)
class Knowledge:
    """dictionary(folded, flags); offices(key) and persons(surname, form) if known; whether mailboxes of duties (info@) are let through."""

    dictionary: DataFrame
    offices: DataFrame | None = None
    persons: DataFrame | None = None
    skip_role_mailboxes: bool = False


def segments_of(docs: DataFrame, known: Knowledge) -> Segments:
    """The parts of docs(doc_id, text) that all rules read, checkpointed; rows of one doc_id have one text.

    Only segments near what can begin a candidate leave the task that reads a text, as their bytes: tokens, which are many
    times as large, are unfolded where the segments lie, by each plan that reads them. Plans join and window them as they
    are dealt. Checkpoints hold texts' words: they stand below spark.checkpoint.dir until the application ends, and are
    removed then.
    """
    spark = docs.sparkSession
    # rules are wide expressions; inferring filters from them takes the optimiser minutes and finds none
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    # tokens meet by segment and place: they lie by segment, and that is enough
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    shared_folder(spark)
    return segments(docs, known.dictionary)


def decisions(docs: DataFrame, known: Knowledge, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each candidate of docs(doc_id, text): doc_id, rule, ty, places, codes, total, vetoed, masked, holes.

    Rows of one doc_id have one text. kinds: only candidates of these are looked for; those of others hide and confirm nothing.
    """
    return decided(segments_of(docs, known), known, kinds)


def decided(found: Segments, known: Knowledge, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """decisions() on segments."""
    d = evidence.placed(rules.candidates(found, kinds), found)
    d = evidence.without_role_mailboxes(d) if known.skip_role_mailboxes else d
    return evidence.with_holes(evidence.decide(evidence.collect(d, known.offices, known.persons)), rules.context(found.tokens(rules.PLACED)))


def text_key(text: Column) -> Column:
    """What texts are analysed and joined by: equal texts have equal masks, whatever their rows' ids."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of docs, by their key. Of equal ones segments() keeps one."""
    return docs.where("text is not null").select(text_key(F.col("text")).alias("doc_id"), "text")


def mask_df(docs: DataFrame, known: Knowledge, profile: Profile = Profile()) -> DataFrame:
    """docs(text, ...) with masked and spans under a profile.

    Rows are masked by their text alone: ids may be null, repeated or missing, and equal texts get equal masks. A null
    text stays null, an empty one empty. A binary text may hold any bytes: its mask is binary, its spans are in bytes.
    Columns masked and spans of docs are replaced, all others are kept. An empty table gives an empty result; an empty
    dictionary is refused. The analysis runs when this is called (its tables are checkpointed), the masks when the result
    is used; the session keeps constraint propagation off.
    """
    return masked_by(docs, decisions(texts(docs), known), profile)


def masked_by(docs: DataFrame, decided: DataFrame, profile: Profile = Profile(), glued: bool = True) -> DataFrame:
    """mask_df() of docs by the decisions on their texts(). All masks are made here."""
    found = spans.allowed(spans.resolve(decided), None if profile.kinds is None else list(profile.kinds))
    found = spans.glue(found) if glued else found
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("masked", "spans")])
    out = spans.mask(docs.select(row.alias("_row"), text_key(F.col("text")).alias("doc_id"), "text"), found, profile.mask_mode)
    return out.select("_row.*", "spans", "masked")


def by_row(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found, whose doc_id is the key of a text, with the doc_id of each row of docs(doc_id, text) that has the text."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_text"))
    return rows.join(found.withColumnRenamed("doc_id", "_key"), F.col("_text") == F.col("_key")).drop("_text", "_key")


def explain_df(docs: DataFrame, known: Knowledge) -> DataFrame:
    """A row for each span of each row of docs(doc_id, text) that is masked after resolution or rejected: doc_id, status, ty, start_b, end_b, total, codes, rule.

    Rows with null or repeated ids are explained like others, each by its own text.
    """
    return explained(docs, decisions(texts(docs), known))


def explained(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """explain_df() of docs by the decisions on their texts(), with end_b."""
    d = decided.withColumn("_item", F.struct("start", "end", "ty"))
    kept = spans.resolve(d).select(F.col("doc_id").alias("_d"), F.explode("spans").alias("s")).select("_d", F.struct("s.start", "s.end", "s.ty").alias("_kept")).distinct()
    d = d.join(kept, (F.col("doc_id") == F.col("_d")) & (F.col("_item") == F.col("_kept")), "left")
    status = F.when(~F.col("masked"), "rejected").when(F.col("_d").isNotNull(), "masked").otherwise("overlapped")
    d = d.withColumn("status", status).where("status <> 'overlapped'")
    return by_row(docs, d).select("doc_id", "status", "ty", "start_b", "end_b", "total", "codes", "rule")


def detect_spans(docs: DataFrame, known: Knowledge, profile: Profile = Profile()) -> DataFrame:
    """A row for each span that mask_df masks: doc_id, ty, start, end (characters), start_b."""
    return mask_df(docs.select("doc_id", "text"), known, profile).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.ty", "s.start", "s.end", "s.start_b")
