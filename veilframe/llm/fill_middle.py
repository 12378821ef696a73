"""Fill-in-the-middle: texts cut in three and put together again so that the middle comes last.

A text is a row of units: runs of ASCII letters, and any other character alone. Its UTF-8 bytes are counted in fixed
blocks, each with the units that begin and the code points that lie in it, and a Fenwick tree stands over the blocks. A
cut after k units is found by binary lifting: the descent adds up whole ranges of blocks until the one in which unit k
begins, and only that block is looked at byte by byte. Building is linear in the text, a cut is logarithmic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import small_batches, table

#: Bytes of a block. Masks are made for so many blocks at once, whatever the text's length.
BLOCK, AT_ONCE = 2048, 512
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are left plain, and of 100 others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
FIM = "n long, form string, prefix_chars long, middle_chars long, output string"


def begins(data: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether a unit and whether a code point begins there; after_letter: what stands before data."""
    letter = ((data | 0x20) - np.uint8(97)) < 26
    point = (data & 0xC0) != 0x80
    before = np.empty(len(data), bool)
    before[:1] = after_letter
    before[1:] = letter[:-1]
    return point & ~(letter & before), point


def is_letter(byte: int) -> bool:
    return (byte | 0x20) - 97 in range(26)


class Blocks:
    """A Fenwick tree of (units, code points) over the blocks of a text in UTF-8."""

    def __init__(self, data: np.ndarray, block: int = BLOCK) -> None:
        self.data, self.block = data, block
        n = -(-len(data) // block)
        self.tree = np.zeros((n + 1, 2), np.int64)
        for lo in range(0, n, AT_ONCE):
            part = data[lo * block : (lo + AT_ONCE) * block]
            at = np.arange(0, len(part), block)
            for column, mask in enumerate(begins(part, lo > 0 and is_letter(int(data[lo * block - 1])))):
                self.tree[1 + lo : 1 + lo + len(at), column] = np.add.reduceat(mask.view(np.int8), at, dtype=np.int64)
        self.units, self.points = (int(x) for x in self.tree.sum(axis=0))
        step = 1
        while 2 * step <= n:  # each node takes in the one that ends half its range before
            self.tree[2 * step :: 2 * step] += self.tree[step : n + 1 - step : 2 * step]
            step *= 2

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first k units."""
        if k >= self.units:
            return len(self.data), self.points
        n, at, units, points = len(self.tree) - 1, 0, 0, 0
        step = 1 << max(n.bit_length() - 1, 0)
        while step:
            if at + step <= n and units + self.tree[at + step, 0] <= k:
                at += step
                units += int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step >>= 1
        start = at * self.block
        unit, point = begins(self.data[start : start + self.block], start > 0 and is_letter(int(self.data[start - 1])))
        local = int(np.flatnonzero(unit)[k - units])
        return start + local, points + int(point[:local].sum())


def cutter(marks: tuple[str, str, str], block: int) -> Callable:
    """Function of Arrow arrays (text, two draws for the cuts, a plain and a suffix-first decision) -> FIM structs."""
    p, s, m = (x.encode() for x in marks)

    def run(text: pa.Array, first: pa.Array, second: pa.Array, plain: pa.Array, suffix_first: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        for value, h1, h2, as_is, spm in zip(text.cast(pa.binary()), *(x.to_pylist() for x in (first, second, plain, suffix_first))):
            raw = value.as_py()
            blocks = Blocks(np.frombuffer(raw, np.uint8), block)
            n = blocks.units
            if as_is or not n or p in raw or s in raw or m in raw:
                rows.append((n, "plain", None, None, raw))
                continue
            (a, a_points), (b, b_points) = (blocks.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            pieces = (s, raw[b:], p, raw[:a], m, raw[a:b]) if spm else (p, raw[:a], s, raw[b:], m, raw[a:b])
            rows.append((n, "spm" if spm else "psm", a_points, b_points - a_points, b"".join(pieces)))
        n, form, before, middle, out = zip(*rows) if rows else ((),) * 5
        arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(arrays, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) with fim: units n, form (plain, psm, spm), prefix_chars, middle_chars and output.

    The draws come from the SHA-256 of seed and id, so reruns agree in any order of rows: the first two of its 8-digit
    groups place the cuts, the third leaves plain of 100 texts as they are, by the fourth suffix_first of 100 others begin
    with the suffix. A text that holds one of the marks stays plain, so restored() is exact.

    A null text is empty; an empty text stays plain and empty. A null id draws like an empty string, rows that repeat an
    id have the same draws. Very long texts are cut whole, in the memory of a few blocks beside text and output. A column
    fim of docs is replaced, all others are kept. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    cut = F.arrow_udf(cutter(marks, block), FIM)
    return docs.withColumn("fim", cut(F.coalesce("text", F.lit("")), h[0], h[1], h[2] % 100 >= 100 - plain, h[3] % 100 < suffix_first))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that transform() has made output from, by its form alone."""
    p, s, m = marks
    first, second = F.when(form == "psm", F.lit(s)).otherwise(F.lit(p)), F.lit(m)
    body = F.substring(output, F.lit(1) + F.when(form == "psm", len(p)).otherwise(len(s)), F.length(output))
    head = F.substring_index(body, s, 1)
    head = F.when(form == "psm", head).otherwise(F.substring_index(body, p, 1))
    rest = F.substring(body, F.length(head) + F.length(first) + 1, F.length(output))
    tail = F.substring_index(rest, m, 1)
    middle = F.substring(rest, F.length(tail) + F.length(second) + 1, F.length(output))
    prefix, suffix = F.when(form == "psm", head).otherwise(tail), F.when(form == "psm", tail).otherwise(head)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    return d.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
e AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM e"""
