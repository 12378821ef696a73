"""Overlap resolution, profiles, gluing of addresses, and masking."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from veilframe.functions.text import SPACES
from veilframe.functions.types import KINDS

#: synthetic is a name for stars.
MODES = ("stars", "token", "synthetic")
ITEM = "struct<start:int,shorter:int,rank:int,weak:int,ty:string,end:int,start_b:int,holes:array<struct<start:int,end:int>>>"
STATE = f"struct<until:int,kept:array<{ITEM}>>"


def _item() -> Column:
    rank = F.create_map(*[F.lit(x) for k, (_, p) in KINDS.items() for x in (k, -p)])
    return F.struct("start", (F.col("start") - F.col("end")).alias("shorter"), F.element_at(rank, F.col("ty")).alias("rank"), (-F.col("score")).alias("weak"), "ty", "end", "start_b", "holes")


def resolve(d: DataFrame) -> DataFrame:
    """Masked candidates -> (doc_id, spans): in order of start, then longer, of higher priority and score; one is
    picked if it starts at or after the end of all picked before it. Equal ones go by kind.

    Candidates that no earlier one reaches begin a group of their own, so the fold is over groups, not over texts.
    """
    order = Window.partitionBy("doc_id").orderBy("item")
    items = d.where("masked").select("doc_id", _item().cast(ITEM).alias("item"))
    reach = F.max("item.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    items = items.withColumn("_new", F.coalesce(F.col("item.start") >= reach, F.lit(True)).cast("int")).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = items.groupBy("doc_id", "_group").agg(F.sort_array(F.collect_list("item")).alias("all"))
    state = F.struct(F.lit(-1).alias("until"), F.array().cast(f"array<{ITEM}>").alias("kept")).cast(STATE)
    step = lambda a, s: F.when(s["start"] >= a["until"], F.struct(s["end"].alias("until"), F.array_append(a["kept"], s).alias("kept")).cast(STATE)).otherwise(a)
    kept = groups.select("doc_id", F.aggregate("all", state, step, lambda a: a["kept"]).alias("kept"))
    return kept.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("kept"))).alias("spans"))


def allowed(d: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Spans of the profile's kinds (null: all). Comes after resolution: a kind that is not allowed may hide another."""
    return d if kinds is None else d.withColumn("spans", F.filter("spans", lambda s: s["ty"].isin(*kinds)))


def glue(d: DataFrame) -> DataFrame:
    """(doc_id, spans): addresses with exactly one character between become one span, with the holes of both."""
    some = F.exists("spans", lambda s: s["ty"] == "address")
    order = Window.partitionBy("doc_id").orderBy("s.start")
    one = d.where(some).select("doc_id", F.explode("spans").alias("s"))
    last = F.lag("s").over(order)
    follows = (F.col("s.ty") == "address") & (last["ty"] == "address") & (last["end"] + 1 == F.col("s.start"))
    one = one.withColumn("_new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = one.groupBy("doc_id", "_group").agg(F.min("s").alias("head"), F.max("s.end").alias("end"), F.sort_array(F.flatten(F.collect_list("s.holes"))).alias("holes"))
    item = F.struct(*[F.col(f"head.{c}").alias(c) for c in ("start", "shorter", "rank", "weak", "ty")], "end", F.col("head.start_b").alias("start_b"), "holes").cast(ITEM)
    glued = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("spans"))
    return d.where(~some).select("doc_id", "spans").unionByName(glued)


def stars(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{SPACES}]", "*")


def masked_text(text: Column, spans: Column, mode: str) -> Column:
    """text with its spans (ascending, apart) as stars, white space and holes staying, or as labels [kind_byte]."""
    part = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))

    def starred(s: Column) -> Column:
        holes = F.array_sort(s["holes"])
        edge = lambda i: F.when(i == 0, s["start"]).otherwise(F.get(holes, i - 1)["end"])
        pieces = F.transform(F.sequence(F.lit(0), F.size(holes)), lambda i: F.concat(
            stars(part(edge(i), F.when(i < F.size(holes), F.get(holes, i)["start"]).otherwise(s["end"]))),
            F.coalesce(F.when(i < F.size(holes), part(F.get(holes, i)["start"], F.get(holes, i)["end"])), F.lit("")),
        ))
        return F.when(F.size(holes) == 0, stars(part(s["start"], s["end"]))).otherwise(F.array_join(pieces, ""))

    label = lambda s: F.concat(F.lit("["), s["ty"], F.lit("_"), s["start_b"].cast("string"), F.lit("]"))
    ends = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    pieces = F.transform(spans, lambda s, i: F.concat(part(ends(i), s["start"]), label(s) if mode == "token" else starred(s)))
    tail = F.when(F.size(spans) > 0, part(F.element_at(spans, -1)["end"], F.length(text))).otherwise(text)
    return F.concat(F.array_join(pieces, ""), tail)


def masked_bytes(mode: str):
    """Arrow function of binary texts and their spans, which are in bytes, to masked texts: a star for each byte that is no
    continuation, white space and holes staying, or labels. Bytes outside spans are copied."""
    star = bytes(b if b in b" \t\n\x0b\f\r" else 42 for b in range(256))
    within = bytes(range(0x80, 0xC0))

    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for raw, some in zip(text.to_pylist(), spans.to_pylist()):
            parts, at = [], 0
            for s in some:
                parts.append(raw[at : s["start"]])
                at = s["start"]
                if mode == "token":
                    parts.append(f"[{s['ty']}_{at}]".encode())
                else:
                    for h in sorted((h["start"], h["end"]) for h in s["holes"]):
                        parts += [raw[at : h[0]].translate(star, within), raw[max(at, h[0]) : h[1]]]
                        at = max(at, h[1])
                    parts.append(raw[at : s["end"]].translate(star, within))
                at = s["end"]
            out.append(b"".join([*parts, raw[at:]]))
        return pa.array(out, pa.binary())

    return run


def mask(docs: DataFrame, resolved: DataFrame, mode: str = "stars") -> DataFrame:
    """docs(doc_id, text) with masked and spans; documents without spans are unchanged, null texts stay null. Ids are unique.

    Binary texts, of which spans are in bytes, give binary masks, also where they are not UTF-8.
    """
    none = F.array().cast(f"array<{ITEM}>")
    if mode not in MODES:
        raise ValueError(f"mask mode {mode} is none of {', '.join(MODES)}")
    d = docs.join(resolved.select(F.col("doc_id").alias("_d"), F.col("spans").alias("_spans")), F.col("doc_id") == F.col("_d"), "left").drop("_d").withColumn("spans", F.coalesce("_spans", none)).drop("_spans")
    if isinstance(docs.schema["text"].dataType, BinaryType):
        touched = F.when(F.size("spans") > 0, F.col("text"))
        cut = F.arrow_udf(masked_bytes(mode), "binary")(F.coalesce(touched, F.lit(bytearray())), "spans")
        return d.withColumn("masked", F.when(touched.isNull(), F.col("text")).otherwise(cut))
    return d.withColumn("masked", F.when(F.size("spans") == 0, F.col("text")).otherwise(masked_text(F.col("text"), F.col("spans"), mode)))
