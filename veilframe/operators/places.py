"""Byte offsets from elsewhere (logs, annotations, other tools) looked up in texts: which token and sentence they fall in.

A text is scanned once where it stands; its offsets are found by binary search in the sorted starts of its tokens and in
its sorted sentence ends. Nothing is exploded before the search, and texts are not shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators import scanner

PLACE = "array<struct<offset:int,pos:int,kind:string,start_b:int,end_b:int,sentence:int>>"


def sentence_ends(s: scanner.Scan) -> np.ndarray:
    """Bytes of the batch that end a sentence: line breaks, and dots after words of three letters or more."""
    dots = np.flatnonzero((s.n_b == 1) & (s.data[s.at_b] == 46))
    dots = dots[dots > 0]
    dots = dots[(s.kind[dots - 1] == scanner.WORD) & (s.n[dots - 1] >= 3) & (s.doc[dots - 1] == s.doc[dots])]
    return np.sort(np.append(s.at_b[dots], np.flatnonzero(s.data == 10)))


def _find(text: pa.Array, offsets: pa.Array) -> pa.Array:
    s = scanner.scan(text)
    ends, heads = sentence_ends(s), np.searchsorted(s.doc, np.arange(len(text)))
    out = []
    for d, wanted in enumerate(offsets.to_pylist()):
        lo, hi = s.bounds[d], s.bounds[d + 1]
        inside = [o for o in wanted or () if o is not None and 0 <= o]
        at = np.array(inside, np.int64) + lo
        token = np.minimum(np.searchsorted(s.at_b, at, "right") - 1, np.searchsorted(s.doc, d, "right") - 1)
        sentence = np.searchsorted(ends, np.minimum(at, hi)) - np.searchsorted(ends, lo)
        out.append([
            {"offset": o, "pos": int(t - heads[d]), "kind": scanner.KINDS[s.kind[t]], "start_b": int(s.at_b[t] - lo), "end_b": int(s.at_b[t] + s.n_b[t] - lo), "sentence": int(n)} if hi > lo
            else {"offset": o, "pos": None, "kind": None, "start_b": None, "end_b": None, "sentence": 0}
            for o, t, n in zip(inside, token, sentence)
        ])
    return pa.array(out, pa.list_(pa.struct([("offset", pa.int32()), ("pos", pa.int32()), ("kind", pa.string()), ("start_b", pa.int32()), ("end_b", pa.int32()), ("sentence", pa.int32())])))


def places(text: Column, offsets: Column) -> Column:
    """offsets (array of byte offsets) in a string or binary text -> PLACE: the last token that starts at or before each,
    and the number of sentence ends before it.

    Null and negative offsets are left out; those past the end fall in the last token. In an empty or null text there is no
    token. A token that an e-mail address overlays is found at its own place, the address at its sign.
    """
    return F.arrow_udf(_find, PLACE)(F.coalesce(text.cast("binary"), F.lit(bytearray())), offsets)


def look_up(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs(doc_id, text), wanted(doc_id, offset) -> (doc_id, offset, pos, kind, start_b, end_b, sentence), a row for each different offset of a document.

    Document ids are unique. Texts meet the list of their offsets once, however many these are.
    """
    lists = wanted.groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_set("offset")).alias("_offsets"))
    found = docs.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("_d")).select("doc_id", places(F.col("text"), F.col("_offsets")).alias("p"))
    return found.select("doc_id", F.inline("p"))
