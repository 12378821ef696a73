"""Annotated cases ({{kind|value}} in text between @case and @end) and scores of masks against them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import SPACES


#: Markup, text without a brace, or a brace: possessive, so that long texts need no stack.
_PIECES = r"\{\{[a-z_]+\|[^}]*+(?:\}(?!\})[^}]*+)*+\}\}|[^{]++|\{"
CONVERTED = "marked string, spans array<struct<start:int,end:int,ty:string,start_b:int,end_b:int>>"


def strip_markup(marked: Column) -> Column:
    """{{kind|value}} markup -> struct(text, spans(start, end, ty)) in characters."""
    pieces = F.regexp_extract_all(marked, F.lit(_PIECES), F.lit(0))
    spans = "array<struct<start:int,end:int,ty:string>>"
    state = f"struct<text:string,spans:{spans}>"
    start = F.struct(F.lit("").alias("text"), F.array().cast(spans).alias("spans")).cast(state)

    def step(a: Column, p: Column) -> Column:
        tagged = p.rlike(r"^\{\{[a-z_]+\|")
        value = F.when(tagged, F.substring(p, F.instr(p, "|") + 1, F.length(p) - F.instr(p, "|") - 2)).otherwise(p)
        span = F.struct(F.length(a["text"]).alias("start"), (F.length(a["text"]) + F.length(value)).alias("end"), F.regexp_extract(p, r"^\{\{([a-z_]+)\|", 1).alias("ty"))
        return F.struct(F.concat(a["text"], value).alias("text"), F.when(tagged, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans")).cast(state)

    return F.aggregate(pieces, start, step)


def _convert(text: pa.Array, spans: pa.Array) -> pa.Array:
    marked, kept = [], []
    for raw, some in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist()):
        data = np.frombuffer(raw, np.uint8)
        byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))  # where each character begins
        parts, mine, at = [], [], 0
        for start, end, ty in sorted((s["start"], s["end"], s["ty"]) for s in some or ()):
            if not 0 <= start <= end < len(byte) or byte[start] < at:
                continue
            lo, hi = int(byte[start]), int(byte[end])
            value = raw[lo:hi]
            parts.append(raw[at:lo])
            if b"{{" in value or b"}}" in value or b"|" in value or value.endswith(b"}"):
                parts.append(value)
            else:
                parts.append(b"{{%s|%s}}" % (ty.encode(), value))
                mine.append({"start": start, "end": end, "ty": ty, "start_b": lo, "end_b": hi})
            at = hi
        marked.append(b"".join([*parts, raw[at:]]))
        kept.append(mine)
    places = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ty", pa.string()), ("start_b", pa.int32()), ("end_b", pa.int32())])
    return pa.StructArray.from_arrays([pa.array(marked, pa.binary()).cast(pa.string()), pa.array(kept, pa.list_(places))], ["marked", "spans"])


def add_markup(text: Column, spans: Column) -> Column:
    """text and its spans(start, end, ty) in characters -> struct(marked, spans): {{ty|value}} in the text, and the marked spans
    with their places in bytes too. The inverse of strip_markup() for texts without markup of their own.

    Spans are taken in order; one that begins before the end of another or beyond the text is left out, and a value that
    holds a sign of the markup is not marked. A null text is empty.
    """
    return F.arrow_udf(_convert, CONVERTED)(F.coalesce(text, F.lit("")), spans)


def convert(df: DataFrame, kinds: dict[str, str], size: str = "sentence") -> DataFrame:
    """Annotated rows df(id, text, entities(start, end, type)) -> (id, case): the lines of each case, as load() reads them.

    kinds: our kind for each of theirs; entities of other kinds are left out. Rows whose text holds a line of the format
    itself, or markup, have a null case: the format cannot hold them.
    """
    known = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)]) if kinds else F.create_map().cast("map<string,string>")
    spans = F.transform(F.filter("entities", lambda e: F.map_contains_key(known, e["type"])), lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), F.element_at(known, e["type"]).alias("ty")))
    d = df.select("id", "text", add_markup(F.col("text"), spans).alias("c"))
    some = F.size("c.spans") > 0
    head = F.format_string("@case id=%s size=%s polarity=%s expect=%s\n@text\n%s\n@end\n", F.col("id").cast("string"), F.lit(size), F.when(some, "pos").otherwise("neg"), F.when(some, "mask").otherwise("clean"), F.col("c.marked"))
    return d.select("id", F.when(~F.col("text").rlike(r"(?m)^@(?:end|case )|\{\{[a-z_]+\|"), head).alias("case"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(id, size, polarity, expect, text, spans, probes): the cases of the files at path.

    Files are split between tasks at the beginnings of cases, so one large file is read in parallel and each case once.
    Comments before the first case are passed over; attributes have their usual values where a case does not give them.
    """
    records = spark.read.option("lineSep", "\n@case ").text(path).select(F.regexp_replace("value", "^@case ", "").alias("case")).where(F.col("case").rlike(r"(?m)^@text"))
    head = F.regexp_extract("case", r"^([^\n]*)", 1)
    field = lambda k, usual: F.coalesce(F.nullif(F.regexp_extract(head, rf"(?:^|\s){k}=(\S+)", 1), F.lit("")), F.lit(usual))
    # what stands between the line @text and the line @end, without the last line break
    after = F.regexp_replace("case", r"^[\s\S]*?\n@text[^\n]*\n", "")
    body = F.regexp_replace(F.get(F.split(F.concat(F.lit("\n"), after), r"\n@end"), F.lit(0)), r"^\n|\r$", "")
    probes = F.trim(F.regexp_extract("case", r"(?m)^@probes (.*)$", 1))
    usual = {"id": "?", "size": "sentence", "polarity": "pos", "expect": "mask"}
    return records.select(*[field(k, v).alias(k) for k, v in usual.items()], strip_markup(body).alias("b"), probes.alias("probes")).select("id", "size", "polarity", "expect", "b.*", "probes")


def score(df: DataFrame) -> DataFrame:
    """df(id, text, spans, masked) of star masks -> id, ty, n, hit: characters to mask of each span, but for white space, and those masked."""
    d = df.select("id", "text", "masked", F.explode("spans").alias("s"))
    part = lambda c: F.substring(c, F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    solid = F.regexp_replace(part("text"), f"[{SPACES}]", "")
    hit = F.length(F.regexp_replace(part("masked"), "[^*]", "")) - F.length(F.regexp_replace(part("text"), "[^*]", ""))
    return d.select("id", F.col("s.ty").alias("ty"), F.length(solid).alias("n"), hit.alias("hit"))


def over_masked(df: DataFrame) -> DataFrame:
    """Characters masked outside annotated spans, by case."""
    inside = score(df).groupBy("id").agg(F.sum("hit").alias("inside"))
    stars = F.length(F.regexp_replace("masked", "[^*]", "")) - F.length(F.regexp_replace("text", "[^*]", ""))
    return df.select("id", stars.alias("all")).join(inside, "id", "left").select("id", (F.col("all") - F.coalesce("inside", F.lit(0))).alias("over"))


def summary(scored: DataFrame) -> DataFrame:
    """Recall by kind; kinds that begin with x_ are neutral."""
    return scored.where("not startswith(ty, 'x_')").groupBy("ty").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).withColumn("recall", F.round(F.col("hit") / F.greatest("n", F.lit(1)), 6))


def summary_by_size(df: DataFrame) -> DataFrame:
    """Mean recall of the cases df(id, size, text, spans, masked) by size: a case's recall is over all its characters to mask."""
    by_case = score(df).where("not startswith(ty, 'x_')").groupBy("id").agg((F.sum("hit") / F.greatest(F.sum("n"), F.lit(1))).alias("recall"))
    return df.select("id", "size").join(by_case, "id").groupBy("size").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("cases"))
