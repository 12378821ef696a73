"""Audit of how the sources of each language differ in their words.

Terms travel as 64-bit digests: counts are shuffled by language, source and digest, without the strings. The strings meet
once, in one small table of each digest's least and greatest string: where the two differ, different terms share a digest,
and only those digests are split by their strings. Text is joined back to the terms that stay in the report.

With p a term's smoothed frequency in a source, in parts of 10^9, and q that in another source or in the language, a
term's divergence is floor((p - q)^2 / q). Sums over a pair of sources run over the terms that one of them has: terms that
neither has give one value each time, and terms that one has give a value by their count, so counts of counts are enough;
terms of both are summed up in the tasks that hold them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import settle, small_batches, table

TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts of a frequency, terms in so many documents at least stay, and ranks of the report on terms.
SCALE, LEAST_DOCS, MOST_RANKS = 1_000_000_000, 3, 200
#: A task sends on what it has counted once it holds so many terms of its sources.
MOST_HELD = 800_000
#: Texts are read in pieces of about so many bytes.
PIECE = 1 << 20
#: Languages' and sources' totals go to all tasks up to so many pairs of them, a few megabytes; beyond, they are joined.
MOST_TOTALS = 50_000
#: Each source's terms are ranked in so many parts first.
PARTS = 64
PARTIAL = "lang string, source string, term string, n long, docs long, first boolean"


def found(text: bytes, term: re.Pattern = re.compile(TERM)) -> Iterator[list[bytes]]:
    """The terms of a text in lower case, by pieces that end between terms."""
    at = 0
    while len(text) - at > PIECE:
        inside = term.match(text, at + PIECE)
        end = inside.end() if inside else at + PIECE
        yield term.findall(text[at:end].lower())
        at = end
    yield term.findall((text[at:] if at else text).lower())


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> PARTIAL rows: occurrences and documents of each term among the rows that a task holds together.

    first marks one row of each term among them, whatever its source.
    """
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            new = set(terms).difference(seen)
            seen |= new
            for i in range(0, len(terms), 50_000):
                some = terms[i : i + 50_000]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([t in new for t in some], pa.bool_())], ["lang", "source", "term", "n", "docs", "first"])
        held.clear()

    for batch in batches:
        lang, source = (batch.column(c).to_pylist() for c in (0, 1))
        for g, raw in zip(zip(lang, source), batch.column(2).cast(pa.binary()).to_pylist()):
            n, docs = held.setdefault(g, (Counter(), Counter()))
            pieces = found(raw)
            terms = next(pieces)
            n.update(terms)
            once = set(terms)
            for terms in pieces:
                n.update(terms)
                once.update(terms)
            docs.update(once)
        if sum(len(n) for n, _ in held.values()) > MOST_HELD:
            yield from sent()
    yield from sent()


def digest(term: Column, bits: int) -> Column:
    return F.xxhash64(term) if bits == 64 else F.call_function("shiftrightunsigned", F.xxhash64(term), F.lit(64 - bits))


def split_collisions(partials: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """partials(.., digest) and words(digest, least, most) -> partials with split, names(digest, split, term).

    split numbers the different terms of a digest, 0 for nearly all. Only rows of digests with two terms meet their strings.
    """
    one = words.where("least = most").select("digest", F.lit(0).alias("split"), F.col("least").alias("term"))
    shared = words.where("least <> most").select("digest")
    if not shared.take(1):
        return partials.withColumn("split", F.lit(0)), one
    terms = partials.join(shared, "digest", "left_semi").select("digest", "term").distinct()
    several = settle(terms.withColumn("split", F.row_number().over(Window.partitionBy("digest").orderBy("term")) - 1), "split")
    split = partials.join(several, ["digest", "term"], "left").withColumn("split", F.coalesce("split", F.lit(0)))
    return split, one.unionByName(several.select("digest", "split", "term"))


def frequency(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact at any size."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, (total + kept).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs up to SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def shared_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, sources, p, p0) of terms, lists over the sources that have it -> (lang, source, item, value).

    For ordered pairs of sources that both have a term: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), summed over the task's
    terms; q is the item's. Pairs are met a source at a time, against all entries of its terms, and only sums leave the task.
    """
    sums: dict[str, dict[tuple[str, str], int]] = {}
    f = lambda p, q: (p - q) ** 2 // q
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in dict.fromkeys(langs.tolist()):
            rows = batch.filter(pa.array(langs == lang))
            lists = rows.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            names = flat.dictionary_encode()
            source, known = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
            p, p0 = (rows.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            term = np.repeat(np.arange(len(size)), size)
            start = np.cumsum(size) - size
            into = sums.setdefault(lang, {})
            for a in range(len(known)):
                mine = np.flatnonzero(source == a)
                n = size[term[mine]]
                other = np.repeat(start[term[mine]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own = np.repeat(mine, n)
                keep = source[other] != a
                own, other = own[keep], other[keep]
                value = f(p[own], p[other]) - f(p[own], p0[other]) - f(p0[own], p[other]) + f(p0[own], p0[other])
                total, seen = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
                np.add.at(total, source[other], value)
                seen[source[other]] = True
                for b in np.flatnonzero(seen).tolist():
                    pair = known[a], known[b]
                    into[pair] = into.get(pair, 0) + int(total[b])
    for lang, into in sums.items():
        pairs = list(into)
        for i in range(0, len(pairs), 50_000):
            some = pairs[i : i + 50_000]
            columns = [pa.array([lang] * len(some)), pa.array([a for a, _ in some]), pa.array([b for _, b in some]), pa.array([into[x] for x in some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_ranks: int = MOST_RANKS, bits: int = 64) -> DataFrame:
    """docs(text, lang, source, ...) -> (lang, source, part, item, value, rank).

    part pair: for each source of a language every other one, by the divergence summed over the language's kept terms.
    part term: the terms that a source has more often than its language, by their divergence, up to most_ranks. Terms are
    runs of ASCII letters and characters beyond ASCII, A-Z in lower case; those in least_docs documents of a language stay.

    Null texts, languages and sources are empty strings. Sources without a term take part in pairs. Each row is a document
    of its own, repeated ids and rows included. Very long texts are read whole, in pieces. Ties go by the item's UTF-8
    bytes. An empty table gives an empty result; other columns are ignored. bits: of the digests; with few of them terms
    collide and are split, and the result stays the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partials = settle(d.mapInArrow(partial_counts, PARTIAL).withColumn("digest", digest(F.col("term"), bits)), "partials")
    groups = d.select("lang", "source").distinct()

    words = settle(partials.where("first").groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("most")), "words")
    split, names = split_collisions(partials, words)
    key = ["lang", "digest", "split"]
    # dealt by term once: rows of a term are few a task already, so nothing would be combined before the shuffle
    counts = split.select("lang", "source", "digest", "split", "n", "docs").repartition("lang", "digest").groupBy("lang", "source", "digest", "split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = counts.groupBy(*key).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("has")).where(F.col("docs") >= least_docs)
    terms = settle(of_term.select(*key, "lang_n", "has"), "terms")

    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = terms.select("lang", F.explode("has").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    totals = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept", "lang_total")])
    totals = settle(totals.withColumn("p0", F.when(F.col("kept") > 0, frequency(F.lit(0).cast("long"), F.col("total"), F.col("kept")))), "totals")
    small = totals.limit(MOST_TOTALS + 1).count() <= MOST_TOTALS
    side = (lambda t: F.broadcast(t)) if small else (lambda t: t)

    rows = terms.select(*key, "lang_n", F.explode("has").alias("x")).select(*key, "lang_n", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    rows = rows.join(side(totals), ["lang", "source"]).withColumn("p", frequency(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", frequency(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    entries = settle(rows.select(*key, "source", "p", "p0", "q"), "entries")
    return _pairs(entries, totals, side).unionByName(_terms(entries, names, most_ranks))


def _pairs(entries: DataFrame, totals: DataFrame, side) -> DataFrame:
    """All ordered pairs of a language's sources with their summed divergence."""
    long = "lang string, source string, item string, value long"
    lists = entries.groupBy("lang", "digest", "split").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("x")).where("size(x) > 1")
    both = lists.select("lang", "x.source", "x.p", "x.p0").mapInArrow(shared_sums, long)
    other = side(totals.where("kept > 0").select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
    # a term of one source alone, by its frequency there: against the other's p0 on either side
    of_one = entries.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n")).join(other, "lang").where("source <> item")
    none = divergence(F.col("p0"), F.col("q0"))
    ahead = of_one.select("lang", "source", "item", (F.col("n") * (divergence(F.col("p"), F.col("q0")) - none)).alias("value"))
    behind = of_one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * (divergence(F.col("q0"), F.col("p")) - divergence(F.col("q0"), F.col("p0")))).alias("value"))
    alone = totals.select("lang", "source", "p0", "kept").join(side(totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))), "lang").where("source <> item")
    rest = alone.select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * none).otherwise(0).cast("long").alias("value"))
    sums = both.unionByName(ahead).unionByName(behind).unionByName(rest).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(entries: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """The most divergent terms of each source. Strings are joined to those at or above its last value alone."""
    group = ["lang", "source"]
    e = entries.where("p > q").select(*group, "digest", "split", divergence(F.col("p"), F.col("q")).alias("value")).withColumn("_part", F.pmod("digest", F.lit(PARTS)))
    first = e.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(F.desc("value"), "digest", "split"))).where(F.col("_r") <= most)
    last = first.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "digest", "split"))).where(F.col("_r") <= most)
    floor = last.groupBy(*group).agg(F.min("value").alias("_floor"))
    named = e.join(floor, group).where("value >= _floor").join(names, ["digest", "split"]).withColumnRenamed("term", "item")
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(F.desc("value"), "item"))).where(F.col("_r") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= most)
    return ranked.select(*group, F.lit("term").alias("part"), "item", "value", "rank")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + v.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM y
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM z) WHERE rank <= 200"""
