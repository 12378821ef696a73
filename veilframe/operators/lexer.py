"""Texts to tokens: one row a token, with places in characters and bytes, dictionary flags, ranks and sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from veilframe.functions.text import fold
from veilframe.functions.types import FLAG
from veilframe.operators import scanner
from veilframe.operators.scanner import DIGITS, EMAIL, SPACE, WORD, Scan

#: The dictionary goes to executors whole up to so many bytes of words and flags, some 700,000 entries of which Python makes
#: about 100 MB; a larger one is joined by a shuffle.
MOST_BROADCAST = 16 << 20


def by_place() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")


#: Categories of words that can begin or anchor a candidate; digits, e-mails and initials can too.
ANCHORS = sum(FLAG[n] for n in "name surn patr geo country kw_addr addr_marker kw_org role kw_card kw_holder".split())
#: Tokens are kept so many content tokens and bytes on either side of an anchor: rules reach 33 content tokens, their contexts 20 more.
REACH, REACH_BYTES = 60, 256
TOKEN = "pos int, kind string, surface string, folded string, flags long, start int, end int, start_b int, end_b int, at int, n_c int, n_b int, content boolean, rank int, sentence int, stop boolean"
COUNTS = "kind string, n long, chars long, bytes long"
#: Up to PIECE_TOKENS tokens of a segment in one row, as the bytes they tile and what was read off them. pos, at, at_b: of the first of
#: them; rank, sentence: before the segment's first; chars: of the text, up to SHORT; hints: what the segment has. Arrays that would
#: say nothing are null: ends (in units) where bytes are units, flags where no word is known, lefts where no e-mail is.
PIECE = (
    "seg int, pos int, at int, at_b int, rank int, sentence int, chars int, hints long, bytes binary, marks array<tinyint>, ends_b array<int>, ends array<int>, "
    "flags array<bigint>, lefts array<int>, lefts_b array<int>"
)
PIECE_TOKENS = 512
#: In marks beside the kind: a dot that ends a sentence; a token that ends one.
STOP, ENDS = 8, 16
#: In hints beside the flags of the segment's words.
HAS_DIGITS, HAS_MAIL, HAS_INITIAL = 1 << 40, 1 << 41, 1 << 42
#: Texts of fewer characters may consist of one value.
SHORT = 64


def flags_in(s: Scan, flags_of: dict[bytes, int]) -> np.ndarray:
    """Category bits of each token: words are looked up folded."""
    flags = np.zeros(len(s.kind), np.int64)
    words = np.flatnonzero(s.kind == WORD)
    low, get = s.low.tobytes(), flags_of.get
    flags[words] = [get(low[a:b], 0) for a, b in zip(s.at_b[words].tolist(), (s.at_b + s.n_b)[words].tolist())]
    return flags


def anchors(s: Scan, flags: np.ndarray) -> np.ndarray:
    """Tokens that can begin or anchor a candidate: words of some categories, digits, e-mails and initials."""
    found = (flags & ANCHORS != 0) | (s.kind == DIGITS) | (s.kind == EMAIL)
    two = np.flatnonzero((s.kind[:-1] == WORD) & (s.n_b[:-1] == 2) & (s.data[s.at_b[1:]] == 46) & (s.doc[1:] == s.doc[:-1]))
    first, second = s.data[s.at_b[two]], s.data[s.at_b[two] + 1]
    found[two[((first >= 65) & (first <= 90)) | ((first == 0xD0) & ((second == 0x81) | ((second >= 0x90) & (second <= 0xAF))))]] = True
    return found


def near_anchors(anchor: np.ndarray, content: np.ndarray, at_b: np.ndarray, n_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one text's tokens those to keep, and the number of the segment that each lies in. An e-mail's left side lies in its segment."""
    hit, size = np.flatnonzero(anchor), len(anchor)
    places, rank = np.flatnonzero(content), np.cumsum(content)
    near = lambda to: places[np.clip(to, 0, len(places) - 1)]
    lo = np.minimum(near(rank[hit] - 1 - REACH), np.searchsorted(at_b, start_b[hit] - REACH_BYTES))
    hi = np.maximum(near(rank[hit] - 1 + REACH), np.searchsorted(at_b, at_b[hit] + n_b[hit] + REACH_BYTES) - 1)
    # past the last content token the text's end belongs to the segment
    lo, hi = np.where(rank[hit] - 1 <= REACH, 0, lo), np.where(rank[hit] - 1 + REACH >= len(places) - 1, size - 1, hi)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + 1, -1)
    keep = np.cumsum(change[:-1]) > 0
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    return keep, np.cumsum(first)


def sentences(s: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Dots after words of three letters or more, and tokens that end a sentence: such dots and line breaks."""
    stop = np.zeros(len(s.kind), bool)
    stop[1:] = ((s.n_b == 1) & (s.data[s.at_b] == 46))[1:] & (s.kind[:-1] == WORD) & (s.n[:-1] >= 3) & (s.doc[1:] == s.doc[:-1])
    lines = np.append(0, np.cumsum(s.data == 10))
    return stop, stop | ((s.kind == SPACE) & (lines[s.at_b + s.n_b] > lines[s.at_b]))


def columns(s: Scan, flags: np.ndarray, in_bytes: bool) -> list[pa.Array]:
    """Columns of the tokens (TOKEN)."""
    size, doc = len(s.kind), s.doc
    content = (s.kind < SPACE) | (s.kind == EMAIL)
    heads = np.searchsorted(doc, np.arange(len(s.bounds) - 1))  # the first token of each text
    of_doc = lambda run: run - np.append(0, run)[heads][doc]  # a running count within each text
    stop, ends = sentences(s)
    rank, sentence = of_doc(np.cumsum(content)), of_doc(np.cumsum(ends)) - ends
    at, at_b, start, start_b = s.at - s.first_unit[doc], s.at_b - s.bounds[doc], s.start - s.first_unit[doc], s.start_b - s.bounds[doc]
    place, place_start, place_size = (at_b, start_b, s.n_b) if in_bytes else (at, start, s.n)
    names = pa.DictionaryArray.from_arrays(pa.array(s.kind), pa.array(scanner.KINDS)).cast(pa.string())
    whole = lambda x, t=pa.int32(): pa.array(x, t)
    every = np.arange(size)
    return [
        whole(every - heads[doc]), names, s.strings(s.data, every), s.strings(s.low, every, s.kind == WORD), whole(flags, pa.int64()), whole(place_start), whole(place + place_size), whole(start_b), whole(at_b + s.n_b),
        whole(place), whole(s.n), whole(s.n_b), whole(content, pa.bool_()), whole(rank), whole(sentence), whole(stop, pa.bool_()),
    ]


def in_pieces(s: Scan, flags: np.ndarray, around: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """The text of each piece, and the pieces' columns (PIECE). around: only tokens near anchors are kept, else all, as one segment a text."""
    size, doc = len(s.kind), s.doc
    content = (s.kind < SPACE) | (s.kind == EMAIL)
    heads = np.searchsorted(doc, np.arange(len(s.bounds) - 1))
    stop, ends = sentences(s)
    seg, keep = np.ones(size, np.int64), np.ones(size, bool)
    if around:
        anchor, at_b, start_b = anchors(s, flags), s.at_b - s.bounds[doc], s.start_b - s.bounds[doc]
        keep[:] = False
        for d in np.unique(doc[anchor]).tolist():
            lo, hi = heads[d], heads[d + 1] if d + 1 < len(heads) else size
            keep[lo:hi], seg[lo:hi] = near_anchors(anchor[lo:hi], content[lo:hi], at_b[lo:hi], s.n_b[lo:hi], start_b[lo:hi])
    kept = np.flatnonzero(keep)
    if not len(kept):
        return np.zeros(0, np.int64), []
    fresh = np.append(True, (doc[kept[1:]] != doc[kept[:-1]]) | (seg[kept[1:]] != seg[kept[:-1]]))
    head = np.flatnonzero(fresh)  # of each segment the first token, as a place in kept
    of_seg = np.cumsum(fresh) - 1
    cut = np.flatnonzero((np.arange(len(kept)) - head[of_seg]) % PIECE_TOKENS == 0)
    first, d, g = kept[cut], doc[kept[cut]], of_seg[cut]
    bounds = np.append(cut, len(kept))
    piece = np.cumsum(np.isin(np.arange(len(kept)), cut)) - 1
    from_b, to_b = s.at_b[first], (s.at_b + s.n_b)[kept[bounds[1:] - 1]]
    before = lambda x: (lambda run: run[kept[head]] - run[heads[doc[kept[head]]]])(np.append(0, np.cumsum(x)))[g]  # of the text, up to the segment
    initial = np.zeros(size, bool)
    initial[:-1] = (s.kind[:-1] == WORD) & (s.n_b[:-1] == 2) & (s.data[s.at_b[1:]] == 46)
    hints = np.bitwise_or.reduceat((flags | (s.kind == DIGITS) * HAS_DIGITS | (s.kind == EMAIL) * HAS_MAIL | initial * HAS_INITIAL)[kept], head)[g]
    points, length = np.append(0, np.cumsum((s.data & 0xC0) != 0x80)), np.diff(s.bounds)
    chars = np.where(length >= 4 * SHORT, SHORT, np.minimum(points[s.bounds[1:]] - points[s.bounds[:-1]], SHORT))[d]
    offsets = pa.array(bounds, pa.int32())
    some = lambda x: np.logical_or.reduceat(x, cut)

    def lists(values: np.ndarray, ty: pa.DataType, says=None) -> pa.Array:
        return pa.ListArray.from_arrays(offsets, pa.array(values, ty), mask=None if says is None else pa.array(~says))

    text = pa.Array.from_buffers(pa.binary(), 2 * len(cut) - 1, [None, pa.py_buffer(np.stack([from_b, to_b], 1).ravel().astype(np.int32)), pa.py_buffer(s.data)])
    mail, n, n_b = (s.kind == EMAIL)[kept], s.n[kept], s.n_b[kept]
    has_mail = some(mail)
    ints = lambda x: pa.array(x, pa.int32())
    return d, [
        ints(seg[first]), ints(first - heads[d]), ints(s.at[first] - s.first_unit[d]), ints(from_b - s.bounds[d]), ints(before(content)), ints(before(ends)), ints(chars), pa.array(hints, pa.int64()),
        text.take(pa.array(np.arange(0, 2 * len(cut), 2))), lists((s.kind + STOP * stop + ENDS * ends)[kept], pa.int8()), lists((s.at_b + s.n_b)[kept] - from_b[piece], pa.int32()),
        lists((s.at + s.n)[kept] - s.at[first][piece], pa.int32(), some(n != n_b)), lists(flags[kept], pa.int64(), some(flags[kept] != 0)),
        lists((s.at - s.start)[kept], pa.int32(), has_mail), lists((s.at_b - s.start_b)[kept], pa.int32(), has_mail),
    ]


def lexed(flags_of, in_bytes: bool, names: list[str]) -> Callable:
    """Batches of (doc_id, text as binary) to TOKEN rows. flags_of: a broadcast of the dictionary, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = flags_of.value if flags_of is not None else {}
        for batch in batches:
            for some in _slices(batch):
                s = scanner.scan(some.column(1))
                if len(s.kind):
                    out = columns(s, flags_in(s, known) if known else np.zeros(len(s.kind), np.int64), in_bytes)
                    for lo in range(0, len(s.doc), 20_000):
                        ids = some.column(0).take(pa.array(s.doc[lo : lo + 20_000]))
                        yield pa.RecordBatch.from_arrays([ids, *[c[lo : lo + 20_000] for c in out]], names)

    return run


def cut_up(flags_of, names: list[str]) -> Callable:
    """Batches of (doc_id, text as binary) to PIECE rows: near anchors if there is a dictionary, else of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = flags_of.value if flags_of is not None else {}
        for batch in batches:
            for some in _slices(batch):
                s = scanner.scan(some.column(1))
                if len(s.kind):
                    doc, out = in_pieces(s, flags_in(s, known) if known else np.zeros(len(s.kind), np.int64), bool(known))
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(doc)), *out], names)

    return run


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of about a megabyte of text at a time."""
    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def counted(names: list[str]) -> Callable:
    """Batches of (doc_id, text as binary) to COUNTS rows, one for each text and kind in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scanner.scan(batch.column(1))
            cell, many = s.doc * len(scanner.KINDS) + s.kind, batch.num_rows * len(scanner.KINDS)
            n, chars, size = (np.bincount(cell, w, many).astype(np.int64) for w in (None, s.n, s.n_b))
            some = np.flatnonzero(n)
            kinds = pa.array(scanner.KINDS).take(pa.array(some % len(scanner.KINDS)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some // len(scanner.KINDS))), kinds, *[pa.array(x[some]) for x in (n, chars, size)]], names)

    return run


def _rows(docs: DataFrame, function: Callable, ddl: str, *args) -> DataFrame:
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL(ddl)])
    return docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(function(*args, schema.names), schema)


def kind_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, kind, n, chars, bytes): tokens of each kind in each text. Null and empty texts have none."""
    return _rows(docs, counted, COUNTS)


def _shared(docs: DataFrame, dictionary: DataFrame):
    """A broadcast of the dictionary's flags by word, or None if it has more than MOST_BROADCAST bytes."""
    size = dictionary.agg(F.sum(F.octet_length("folded") + 8)).first()[0]
    if size is None:
        raise ValueError("an empty dictionary would leave all names unmasked")
    return docs.sparkSession.sparkContext.broadcast({r.folded.encode(): r.flags for r in dictionary.collect()}) if size <= MOST_BROADCAST else None


def _flagged(t: DataFrame, dictionary: DataFrame) -> DataFrame:
    words = dictionary.select(F.col("folded").alias("_w"), F.col("flags").alias("_f"))
    return t.join(words, F.col("folded") == F.col("_w"), "left").withColumn("flags", F.coalesce("_f", F.lit(0).cast("long"))).drop("_w", "_f")


def tokens(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """docs(doc_id, text), dictionary(folded, flags) -> a row a token.

    at: where its piece starts; start, end, start_b, end_b: place in characters and bytes, an e-mail's with its left
    side, whose words are tokens too; content: words, digits and e-mails; rank: number of content tokens up to here;
    sentence: boundaries before it (a dot after three letters or more, a line break).

    text may be a string or any bytes: bytes that are not UTF-8 are tokens of kind other, or letters where D0 or D1 begins
    them, of as many bytes as their first announces. Of a binary text all places are in bytes.

    Document ids are unique. Null text is empty and has no tokens. The dictionary goes to executors whole up to
    MOST_BROADCAST bytes; a larger one is joined by a shuffle.
    """
    flags_of = _shared(docs, dictionary)
    t = _rows(docs, lexed, TOKEN, flags_of, isinstance(docs.schema["text"].dataType, BinaryType))
    return t if flags_of is not None else _flagged(t, dictionary)


@dataclass(frozen=True)
class Segments:
    """The parts of texts that can hold candidates: PIECE rows dealt by doc_id, which is (id, seg) here, and kept; in_bytes: places are in bytes.

    known: all tokens of a dictionary too large for tasks, with their flags, in the place of those that pieces give.
    """

    pieces: DataFrame
    in_bytes: bool
    known: DataFrame | None = None

    def tokens(self, hints: int | None = None) -> DataFrame:
        """TOKEN rows of the segments that have one of the hints: what tokens() gives for their texts."""
        if self.known is not None:
            return self.known
        return unfolded(self.pieces if hints is None else self.pieces.where(F.col("hints").bitwiseAND(F.lit(hints)) != 0), self.in_bytes)

    def texts(self) -> DataFrame:
        """(doc_id, text, first, chars): each segment's text, where it begins in the whole one, and the characters of that, up to SHORT."""
        parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "bytes"))), lambda x: x["bytes"].cast("string"))
        first = F.min("at_b" if self.in_bytes else "at")
        return self.pieces.groupBy("doc_id").agg(F.array_join(parts, "").cast("binary" if self.in_bytes else "string").alias("text"), first.alias("first"), F.max("chars").alias("chars"))


def unfolded(pieces: DataFrame, in_bytes: bool) -> DataFrame:
    """PIECE rows to TOKEN rows, where they stand: a token's columns are read off its piece."""
    t = pieces.select("*", F.posexplode("marks").alias("_i", "_mark"))
    upto = lambda c: F.coalesce(F.get(c, F.col("_i") - 1), F.lit(0))
    units, i = F.coalesce("ends", "ends_b"), F.col("_i")
    from_b, to_b, start, end = upto(F.col("ends_b")), F.get("ends_b", i), upto(units), F.get(units, i)
    kind = F.element_at(F.array(*map(F.lit, scanner.KINDS)), F.col("_mark").bitwiseAND(7).cast("int") + 1)
    surface = F.make_valid_utf8(F.substring("bytes", from_b + 1, to_b - from_b).cast("string")) if in_bytes else F.substring("bytes", start + 1, end - start)
    left = lambda c: F.coalesce(F.get(c, i), F.lit(0))
    at_b, at = F.col("at_b") + from_b, (F.col("at_b") + from_b) if in_bytes else (F.col("at") + start)
    t = t.select(
        "doc_id", (F.col("pos") + i).alias("pos"), kind.alias("kind"), surface.alias("surface"), F.coalesce(F.get("flags", i), F.lit(0).cast("long")).alias("flags"),
        (at - left("lefts_b" if in_bytes else "lefts")).alias("start"), (at + (to_b - from_b if in_bytes else end - start)).alias("end"), (at_b - left("lefts_b")).alias("start_b"), (F.col("at_b") + to_b).alias("end_b"),
        at.alias("at"), (end - start).alias("n_c"), (to_b - from_b).alias("n_b"), "rank", "sentence", (F.col("_mark").bitwiseAND(STOP) != 0).alias("stop"), (F.col("_mark").bitwiseAND(ENDS) != 0).cast("int").alias("_ends"),
    )
    t = t.withColumns({"folded": F.when(F.col("kind") == "word", fold(F.col("surface"))), "content": F.col("kind").isin("word", "digits", "email")})
    w = by_place().rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumns({"rank": (F.col("rank") + F.sum(F.col("content").cast("int")).over(w)).cast("int"), "sentence": (F.col("sentence") + F.sum("_ends").over(w) - F.col("_ends")).cast("int")}).drop("_ends")


def dealt(df: DataFrame) -> DataFrame:
    """df by doc_id, checkpointed: later plans know how its rows lie, so they deal none of them again.

    Spark forgets that of a plan that it adapts while it runs, so adapting is off for this one.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def segments(docs: DataFrame, dictionary: DataFrame) -> Segments:
    """What is left of docs(doc_id, text) near tokens that can begin or anchor a candidate: what is left of a text in one
    piece is a segment. Rules see in a segment all that they would see in the whole text.

    Rows of one doc_id have one text. Segments are kept as the bytes of their texts, a row for PIECE_TOKENS tokens, and
    unfold to tokens where they stand: nothing wider is kept or shuffled. With a dictionary of more than MOST_BROADCAST
    bytes all tokens are kept, a row each, after a shuffle by word.
    """
    flags_of, in_bytes = _shared(docs, dictionary), isinstance(docs.schema["text"].dataType, BinaryType)
    p = _rows(docs, cut_up, PIECE, flags_of).withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), "seg")).drop("seg")
    p = p if in_bytes else p.withColumn("bytes", F.col("bytes").cast("string"))  # of these a plan cuts without a copy
    found = Segments(dealt(p.repartition("doc_id").dropDuplicates(["doc_id", "pos"])), in_bytes)
    if flags_of is not None:
        return found
    return Segments(found.pieces, in_bytes, dealt(_flagged(found.tokens(), dictionary).repartition("doc_id").sortWithinPartitions("doc_id", "pos")))
