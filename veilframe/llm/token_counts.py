"""Counting tokens of whole texts by a public tokenizer; only lengths come back from the tasks.

Texts reach Arrow functions in batches bounded by bytes. There long texts are cut at boundaries over which the tokenizer
never looks, and the pieces are taken in groups of about equal bytes, so that what is held at a time does not depend on
how long texts are. A group is cut at all such boundaries, and the words that its task has not met yet go through the
library; a text's number is the sum over its words. A text without such boundaries is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import small_batches, table

LIMIT = 2048
#: Texts are cut from so many bytes on; groups of pieces hold about so many.
PIECE, GROUP = 64 << 10, 256 << 10
#: Words whose numbers of tokens a task remembers: so many bytes, with ENTRY bytes for each word beside its own.
REMEMBERED, ENTRY = 64 << 20, 150
#: One white space between ASCII letters or digits: pieces end before it.
_SAFE = re.compile(rb"(?=[ \n\t][0-9A-Za-z])(?<=[0-9A-Za-z])")
#: The same between any printable ASCII and letters U+00C0 to U+023F, whose UTF-8 begins with C3 to C8.
_SAFE_WIDE = re.compile(rb"(?=[ \n\t][!-~\xC3-\xC8])(?:(?<=[!-~])|(?<=[\xC3-\xC8][\x80-\xBF]))")
#: The same as _SAFE for tokenizers that put a space before each text themselves: it is left out.
_SAFE_SPACE = re.compile(rb" (?<=[0-9A-Za-z] )(?=[0-9A-Za-z])")


def pieces(text: bytes, safe: re.Pattern | None, size: int, dropped: int = 0) -> list[bytes]:
    """text in pieces of size bytes or a little more, cut after matches of safe without their last dropped bytes."""
    if safe is not None and size <= 1:
        return safe.split(text)
    out, start = [], 0
    while safe is not None and len(text) - start > size:
        cut = safe.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.end() - dropped])
        start = cut.end()
    out.append(text[start:])
    return out


def groups(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about most bytes each, as even as their order allows."""
    total = sum(sizes)
    each = total / max(1, round(total / most))
    out, start, held, cut = [], 0, 0, each
    for i, n in enumerate(sizes):
        held += n
        if held >= cut or i == len(sizes) - 1:
            out.append((start, i + 1))
            start, cut = i + 1, max(cut + each, held + each / 2)
    return out


PLAIN_SIDES = (("ab", "cd"), ("a1", "b2"), ("12", "34"), ("A", "B"), ("word's", "9th"))
#: Each sign and some letters at the end, at the beginning and on both sides.
WIDE_SIDES = (*PLAIN_SIDES, *(x for c in (*map(chr, range(0x21, 0x7F)), *"ÀÉÖ×ß÷éüÿĀİıſǅȿ") for x in (("a" + c, "b"), ("a", c + "b"), (c, c), (c + c, "1" + c))))


def ends_at_spaces(tokenizer, sides: tuple[tuple[str, str], ...] = PLAIN_SIDES) -> bool:
    """Whether this tokenizer of the tokenizers library never looks over a white space between such sides, by default ASCII letters or digits."""
    if tokenizer.pre_tokenizer is None or any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer is not None else str
    for space in " \n\t":
        for a, b in sides:
            if normal(a) + normal(space + b) != normal(a + space + b):
                return False
            whole, left, right = ([p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal(x))] for x in (a + space + b, a, space + b))
            if whole != left + right:
                return False
    return True


def lengths_of(source: bytes, is_json: bool) -> tuple[Callable[[list[bytes]], list[int]], re.Pattern | None, int]:
    """Function of texts to their numbers of tokens; where texts may be cut, and how many bytes are left out there."""
    if is_json:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(source.decode())
        t.no_truncation()
        t.no_padding()
        safe = next((s for s, sides in ((_SAFE_WIDE, WIDE_SIDES), (_SAFE, PLAIN_SIDES)) if ends_at_spaces(t, sides)), None)
        return (lambda texts: [len(e) for e in t.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]), safe, 0
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=source)
    inner = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    own_space = all(sp.encode(f"{a} {b}") == sp.encode(a) + sp.encode(b) for a, b in (("a", "b"), ("word", "1"), ("9", "x"), ("Ab", "cD")))
    return (lambda texts: [len(x) for x in sp.encode([x.decode() for x in texts], num_threads=1)]), (_SAFE_SPACE if own_space and not inner else None), 1


def counter(source: Broadcast, is_json: bool, piece: int, group: int) -> Callable:
    """Arrow function of texts to their numbers of tokens. source: a broadcast of the tokenizer's file, read once a task."""
    loaded: list[tuple] = []
    known: dict[bytes, int] = {}
    held = 0

    def run(text: pa.Array) -> pa.Array:
        nonlocal held
        if not loaded:
            loaded.append(lengths_of(source.value, is_json))
        lengths, safe, dropped = loaded[0]
        parts, of = [], []
        for i, raw in enumerate(text.cast(pa.binary()).to_pylist()):
            mine = pieces(raw, safe, piece, dropped)
            parts += mine
            of += [i] * len(mine)
        out = [0] * len(text)
        for lo, hi in groups([len(p) for p in parts], group):
            words = [pieces(p, safe, 1, dropped) for p in parts[lo:hi]]
            fresh = list(set().union(*words).difference(known))
            known.update(zip(fresh, lengths(fresh)))
            for i, mine in zip(of[lo:hi], words):
                out[i] += sum(map(known.__getitem__, mine))
            held += sum(map(len, fresh)) + ENTRY * len(fresh)
            if held > REMEMBERED:
                known.clear()
                held = 0
        return pa.array(out, pa.int64())

    return run


def n_tokens(text: Column, spark: SparkSession, path: str, piece: int = PIECE, group: int = GROUP) -> Column:
    """Number of tokens of a text column by the tokenizer at path (.json: tokenizers, .model: sentencepiece).

    Begin, end and padding tokens do not count, nothing is truncated, and special strings inside texts are what the
    library makes of them. The file is read on the driver and sent to executors, some megabytes. A null text has none.
    """
    with open(path, "rb") as f:
        source = spark.sparkContext.broadcast(f.read())
    return F.arrow_udf(counter(source, path.endswith(".json"), piece, group), "long")(F.coalesce(text, F.lit("")))


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs(text, ...) with n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens).

    A null text is empty, an empty one has no bytes and no tokens. Each row is counted for itself, so ids may be null,
    repeated or missing. Very long texts are counted whole, in pieces. Columns n_bytes, n_tokens and over_limit of docs
    are replaced, all others are kept. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    d = docs.withColumn("n_tokens", n_tokens(F.col("text"), docs.sparkSession, path))
    return d.withColumns({"n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), "over_limit": F.col("n_tokens") > limit})


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count(d, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
