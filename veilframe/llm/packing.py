"""Packing tokenised documents into sequences whose sources follow target token proportions.

Each source is a queue of tokens, documents in a fixed order. Deficit round-robin serves queues in packets: a queue
earns credit in proportion to its weight and sends a packet when the credit covers one. With equal packets, packet j of
a queue of weight w is due at (j + 1) / w, so its place among all packets is a count over the queues, in closed form.
Credit left over in a window, a partition or a task is thus carried on exactly, and each task places its documents alone
from the queues' totals. Sixteen packets of 128 tokens fill a window; what is left of each queue follows at the end. When
a queue runs dry, the others share the windows by their weights. With very many queues packets are ranked by a range sort
of the times they are due.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import before, settle, small_batches, table

WINDOW, PACKET, END = 2048, 128, 1
#: Up to so many queues every task gets all totals and counts places itself; beyond, packets are ranked by a range sort.
MOST_QUEUES = 512
#: Weights of the registered query, taken in turn by the sources by code point, null last.
TURNS = (1, 2, 3)
#: Words whose ids a task remembers, some tens of megabytes.
MOST_WORDS = 600_000
#: Characters of texts, with ROW for each text beside its own, that a task looks up at once.
GROUP, ROW = 2 << 20, 64
#: Parts of words in one text for the tokenizer's model.
AT_ONCE = 1000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Characters for which this module's own splitting into words is known to equal the tokenizer's: printable ASCII and
#: the letters, digits and signs of Latin-1 and Latin Extended, all of them single, composed and with a lower case among them.
_KNOWN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2016), 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC) if c not in (0xAD, 0x130)]
_PLAIN = [c for c in _KNOWN if c.lower() in _KNOWN]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] in kind)


_LETTERS, _DIGITS, _REST = _class("L"), _class("N"), "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] not in "LN")
PLAIN = re.compile(f"[ \\t\\n\\r{_LETTERS}{_DIGITS}{_REST}]*")
#: Parts of words, and the line ends between words.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[{_REST}]+|\n")


_ASCII = bytes([0x20, 0x09, 0x0A, 0x0D, *range(0x21, 0x7F)])


def is_plain(text: str) -> bool:
    if "<|" in text:
        return False
    if text.isascii():
        return not text.encode().translate(None, _ASCII)
    return PLAIN.fullmatch(text) is not None


def byte_letters() -> str:
    """The letters that byte-level vocabularies write for the 256 bytes: themselves if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))


def joined(strings: pa.Array, between: str) -> str:
    return pc.binary_join(pa.LargeListArray.from_arrays([0, len(strings)], strings), pa.scalar(between, strings.type))[0].as_py()


class Known:
    """Strings numbered as they come, each with its ids in a growing store."""

    def __init__(self) -> None:
        self.strings, self.flat, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids(self, strings: pa.Array, find: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in a row, and where those of each begin, then where the last ones end. find gives both for new strings."""
        coded = strings.dictionary_encode()
        number = np.array(pc.index_in(coded.dictionary, value_set=self.strings).fill_null(-1), np.int64)
        new = number < 0
        if new.any():
            number[new] = len(self.strings) + np.arange(new.sum())
            fresh = coded.dictionary.filter(pa.array(new))
            flat, stops = find(fresh)
            self.strings = pa.concat_arrays([self.strings, fresh])
            self.flat, self.ends = np.append(self.flat, flat), np.append(self.ends, stops[1:] + self.ends[-1])
        at = number[coded.indices.to_numpy()]
        n = self.ends[at + 1] - self.ends[at]
        stops = np.append(0, np.cumsum(n))
        return self.flat[np.repeat(self.ends[at] - stops[:-1], n) + np.arange(stops[-1])], stops


class WordIds:
    """Ids of plain texts. Words (lower case, between white space) and their parts are remembered, so that of a group of
    texts only the parts not met before go through the tokenizer's model, in one call."""

    def __init__(self, tokenizer) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.bare = Tokenizer(tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = byte_letters()
        self.letters = letters[:0x20] + " " + letters[0x21:]
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.parts = Known(), Known()

    def __len__(self) -> int:
        return len(self.words.strings)

    def of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = (codecs.charmap_decode(joined(parts[i : i + AT_ONCE], " ").encode(), "strict", self.letters)[0] for i in range(0, len(parts), AT_ONCE))
        ids = np.concatenate([np.array(self.bare.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts])
        return ids, np.append(0, np.flatnonzero(self.last[ids]) + 1)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = pa.array(PARTS.findall(joined(words, "\n") + "\n"), pa.large_string())
        line = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
        ids, stops = self.parts.ids(found.filter(pa.array(~line)), self.of_parts)
        return ids, stops[np.append(0, np.cumsum(~line)[line])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        words = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        ids, stops = self.words.ids(words.flatten(), self.of_words)
        stops = stops[words.offsets.to_numpy()]
        return [np.append(ids[a:b], np.uint32(END)) for a, b in zip(stops[:-1], stops[1:])]


def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with _t in groups of about GROUP."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(map(len, batch["_t"])) + ROW * len(batch)
        if size >= GROUP:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def tokenised(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds ids (32-bit, little-endian) and n to rows with _t. path: a file of the tokenizers library."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        words = WordIds(tokenizer)
        for batch in grouped(batches):
            texts, out, n = batch["_t"].tolist(), [], []
            plain = list(map(is_plain, texts))
            ready = iter(words.encode([t for t, p in zip(texts, plain) if p]))
            for t, p in zip(texts, plain):
                ids = next(ready) if p else np.array([*tokenizer.encode(t, add_special_tokens=False).ids, END], np.uint32)
                out.append(shrink(ids))
                n.append(len(ids))
            if len(words) > MOST_WORDS:
                words.clear()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "name": batch["name"], "_order": batch["_order"], "n": n, "ids": out})

    return run


def shrink(ids: np.ndarray) -> bytes:
    """Two bytes an id if that is enough, else four; the first byte says which."""
    small = not len(ids) or ids.max() < 1 << 16
    return b"\2" + ids.astype("<u2").tobytes() if small else b"\4" + ids.astype("<u4").tobytes()


def grown(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def ranks(queue: np.ndarray, packet: np.ndarray, full: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Place among all packets of the packet-th one of queue, by the time it is due, ties to the smaller queue."""
    wide = int(weight.max(initial=1)) * (int(full.max(initial=1)) + 1) >= 2**62
    full, weight = (full.astype(object), weight.astype(object)) if wide else (full, weight)
    out = np.empty(len(queue), np.int64)
    step = max(1, 2_000_000 // max(1, len(full)))
    later = np.arange(len(full))
    for i in range(0, len(queue), step):
        q, due = queue[i : i + step, None], packet[i : i + step, None] + 1
        due = due.astype(object) if wide else due
        n = np.minimum(full[None, :], (due * weight[None, :] - (later[None, :] > q)) // weight[q])
        n[np.arange(len(q)), q[:, 0]] = packet[i : i + step]
        out[i : i + step] = n.sum(axis=1)
    return out


def placed(full: np.ndarray | None, weight: np.ndarray | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows with queue, full and tail (the queue's number, full packets and place of its rest) -> pieces.

    full, weight: of all queues by number; None: rows have ranks, the places of their full packets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch[i : i + 2000]
                q0, n, queue, whole, tail = (part[c].to_numpy().astype(np.int64) for c in ("_before", "n", "queue", "full", "tail"))
                first = q0 // PACKET
                cnt = (q0 + n - 1) // PACKET - first + 1
                row = np.repeat(np.arange(len(part)), cnt)
                packet = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                begin, end = np.maximum(q0[row], packet * PACKET), np.minimum((q0 + n)[row], (packet + 1) * PACKET)
                last = packet >= whole[row]
                place = np.where(last, tail[row], 0) + begin - packet * PACKET
                if full is None:
                    rank = np.concatenate([np.zeros(0, np.int64), *[np.asarray(r, np.int64) for r in part["ranks"] if r is not None]])
                else:
                    rank = ranks(queue[row[~last]], packet[~last], full, weight)
                place[~last] += rank * PACKET
                size = end - begin
                over = place % WINDOW + size - WINDOW  # only tails can lie across two windows
                cut = np.flatnonzero(over > 0)
                row, begin, place = np.append(row, row[cut]), np.append(begin, (end - over)[cut]), np.append(place, (place + size - over)[cut])
                size = np.append(np.where(over > 0, size - over, size), over[cut])
                start = begin - q0[row]
                data = [memoryview(grown(x).tobytes()) for x in part["ids"]]
                crc = [zlib.crc32(data[r][4 * a : 4 * (a + b)]) for r, a, b in zip(row.tolist(), start.tolist(), size.tolist())]
                yield pd.DataFrame({"doc_id": part["doc_id"].array[row], "start": start, "length": size, "ids_crc32": crc, "doc_tokens": n[row], "sequence_id": place // WINDOW, "offset": place % WINDOW})

    return run


def ranked(starts: DataFrame, totals: DataFrame) -> DataFrame:
    """(uid, ranks): places among all packets of each document's full packets, by the time they are due, ties to the queue's name."""
    step = 1 << 16
    blocks = totals.where("full > 0").select("name", "weight", "full", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(full - 1) div {step}"))).alias("b"))
    packets = blocks.select("name", "weight", F.explode(F.sequence(F.col("b") * step, F.least(F.col("full"), (F.col("b") + 1) * step) - 1)).alias("packet"))
    order = ["due", "name", "packet"]
    packets = packets.select("name", "packet", ((F.col("packet") + 1) / F.col("weight")).alias("due")).repartitionByRange(*order).sortWithinPartitions(*order)
    packets = settle(packets.select("name", "packet", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "packets")
    along = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = packets.groupBy("p").agg(F.count("*").alias("c"), F.min("m").alias("least")).withColumn("earlier", F.coalesce(F.sum("c").over(along), F.lit(0)))
    packets = packets.join(F.broadcast(parts), "p").select("name", "packet", (F.col("m") - F.col("least") + F.col("earlier")).alias("rank"))
    parts_of = starts.join(totals.select("name", "full"), "name").withColumn("last", F.least(F.col("full"), F.expr(f"(_before + n - 1) div {PACKET} + 1")) - 1)
    mine = parts_of.where(F.expr(f"_before div {PACKET} <= last")).select("uid", "name", F.explode(F.sequence(F.expr(f"_before div {PACKET}"), "last")).alias("packet"))
    return mine.join(packets, ["name", "packet"]).groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("packet", "rank"))), lambda x: x["rank"]).alias("ranks"))


def pack(docs: DataFrame, tokenizer: str, weights: DataFrame | None = None) -> DataFrame:
    """A row for each piece of each row of docs(doc_id, text, source, ...).

    A document's ids are those of its text and the end id. weights(source, weight): whole numbers above 0, the sources'
    shares of every window while their queues last (sources without one: 1); by default their shares of all tokens, so
    that all queues end together. A queue is in order of the md5 of doc_id, then of the text. All windows are full but
    the last.

    Null and empty texts have the end id alone; very long ones are cut at every packet. Null sources are a queue of
    their own. Null ids are kept; repeated rows are packed as often as they come. Any number of sources keeps its
    weights. An empty table gives an empty result. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    named = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("t"))  # null last
    text = F.coalesce("text", F.lit(""))
    order = F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.md5(text))
    rows = docs.select("doc_id", named("source").alias("name"), order.alias("_order"), text.alias("_t"))
    tokens = rows.mapInPandas(tokenised(tokenizer), "doc_id long, name string, _order string, n long, ids binary")
    tokens = settle(tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    sizes = tokens.select("uid", "name", "n", F.concat("_order", F.lpad(F.hex("uid"), 16, "0")).alias("_order"))
    totals = sizes.groupBy("name").agg(F.sum("n").alias("n")).withColumns({"full": F.expr(f"n div {PACKET}"), "left": F.col("n") % PACKET, "_hex": F.md5("name")})
    if weights is None:
        totals = totals.withColumn("weight", F.greatest("full", F.lit(1)))
    else:
        given = weights.groupBy(named("source").alias("name")).agg(F.max("weight").cast("long").alias("weight"))
        totals = totals.join(given, "name", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))
    totals = settle(totals, "totals")
    size = totals.count()
    starts = before(sizes, ["name"], "_order", "n", "_before").select("uid", "name", "n", "_before")
    if size <= MOST_QUEUES:
        queues = totals.orderBy("name").collect()
        along = Window.orderBy("name")  # at most MOST_QUEUES rows
        tail = F.sum("full").over(Window.partitionBy()) * PACKET + F.sum("left").over(along) - F.col("left")
        known = totals.select("name", (F.row_number().over(along) - 1).alias("queue"), "full", tail.alias("tail"))
        rows = tokens.join(starts.select("uid", "_before"), "uid").join(F.broadcast(known), "name")
        return rows.select("doc_id", "n", "ids", "_before", "queue", "full", "tail").mapInPandas(placed(*(np.array([r[c] for r in queues], np.int64) for c in ("full", "weight"))), PIECES)
    every = totals.agg(F.sum("full")).first()[0] * PACKET
    tails = before(totals, [], "_hex", "left", "tail").withColumn("tail", F.col("tail") + every)
    rows = tokens.join(starts.select("uid", "_before"), "uid").join(tails.select("name", "full", "tail"), "name").join(ranked(starts, totals), "uid", "left")
    return rows.select("doc_id", "n", "ids", "_before", F.lit(0).alias("queue"), "full", "tail", "ranks").mapInPandas(placed(None, None), PIECES)


def turns(docs: DataFrame) -> DataFrame:
    """(source, weight): TURNS taken in turn by the sources of docs, by code point, null last."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row for each source
    return docs.select("source").distinct().select("source", F.element_at(F.array(*map(F.lit, TURNS)), (nth - 1) % len(TURNS) + 1).alias("weight"))


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), turns(docs))
