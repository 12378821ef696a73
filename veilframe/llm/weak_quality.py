"""A quality classifier from weak labels.

Overlapping heuristics vote against documents: shares of signs, capitals, repeats and the like, and words that are marked
as toxic by a bounded labelled sample. How often each is right is not known; expectation-maximisation on the counts of
vote patterns over all documents estimates it. The posteriors of the patterns are labels for a linear scorer over hashed
features of the text (its words, their beginnings, and its measures in coarse steps; no votes), trained on a bounded
sample, which then judges every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import WORD, small_batches, table
from veilframe.llm.hashing import Powers, mix64, prefix_hash, texts_in_groups

#: Training sample: about so many documents, of so many features in all at most.
MOST_TRAINED, MOST_FEATURES = 6_000, 4_000_000
#: Labelled sample from which toxic words are learned: about so many documents.
MOST_LABELLED = 8_000
#: A word or beginning is toxic if it stands in so many toxic documents of the sample, such a share of them, and so many times more often than in others.
LEAST_SEEN, LEAST_SHARE, LEAST_ODDS = 4, 0.02, 30
BUCKETS = 1 << 18
#: A feature takes part in the scorer if so many texts of the sample have it, and its number of poor ones is so many standard deviations off.
LEAST_TOLD, LEAST_SCORE = 4, 4.0
#: Lengths of words' beginnings in bytes; coarse steps of a measure.
BEGINNINGS, STEPS = (4, 5, 6), 12
#: Bits of a feature's hash.
HASH = 44
#: A document goes if the scorer gives more than this probability of poor quality.
REJECT = 0.6
MEASURES = ("words", "signs", "signed", "capitals", "doubled", "stutter", "different", "lines", "bars", "lone", "ends", "length")
HEURISTICS = ("few_words", "odd_signs", "signed_words", "mostly_capitals", "shouting", "stuttering", "few_different", "repeated_lines", "bar_lists", "lone_signs", "no_sentences", "toxic_words", "toxic_share")


def _among(signs: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


SPACE, SIGN, ENDING, BAR, END = _among(b" \t\n\v\f\r"), _among(rb"#*$%&<>{}\^~="), _among(b"#*$%&"), _among(b"|"), _among(b".!?")
MARK, UPPER, LOWER = _among(b"!?"), _among(bytes(range(65, 91))), _among(bytes(range(97, 123)))
#: What parts words for the features: white space and all ASCII signs.
PART = np.ones(256, bool)
PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) places of the runs of true."""
    padded = np.zeros(len(inside) + 2, np.int8)
    padded[1:-1] = inside
    edge = np.diff(padded)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _distinct(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct pairs of a text (fewer than 2^20 of them) and the upper HASH bits of a hash, as one number each, in order."""
    keys = of.astype(np.uint64) << np.uint64(HASH) | hashes >> np.uint64(64 - HASH)
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


class Texts:
    """Some texts in one array of bytes, a line break after each, with measures and features by text."""

    def __init__(self, texts: list[bytes], at: Powers) -> None:
        self.n = len(texts)
        sizes = np.array([len(t) + 1 for t in texts])
        self.begin = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        low = np.frombuffer(b"\n".join([*(t.lower() for t in texts), b""]), np.uint8)  # ASCII letters alone: lengths stay
        self.hash = prefix_hash(low, at)
        self.at = at
        self.raw = raw
        self.first, self.last = _edges(~SPACE[raw])
        self.parts = _edges(~PART[raw])

    def of(self, places: np.ndarray) -> np.ndarray:
        """The text that each place is in."""
        return np.searchsorted(self.begin, places, side="right") - 1

    def per_text(self, hit: np.ndarray) -> np.ndarray:
        return np.add.reduceat(hit, self.begin, dtype=np.int64)

    def word_hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix64((self.hash[last] - self.hash[first]) * self.at.down[first] + (last - first).astype(np.uint64))

    def measures(self) -> np.ndarray:
        """A row a text, of MEASURES: the number of words, then shares, mostly by word."""
        raw, first, last, count = self.raw, self.first, self.last, lambda places: np.bincount(self.of(places), minlength=self.n)
        n = count(first)
        words = np.maximum(n, 1)
        hashes, text = self.word_hashes(first, last), self.of(first)
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) if len(hashes) else first[:0]
        different = np.bincount((_distinct(text, hashes) >> np.uint64(HASH)).astype(np.int64), minlength=self.n)
        start, stop = _edges(raw != 10)
        solid = np.add.reduceat((~SPACE[raw]).astype(np.int64), start) > 0 if len(start) else np.zeros(0, bool)
        start, stop = start[solid], stop[solid]
        line, of_line = self.word_hashes(start, stop), self.of(start)
        pairs = (_distinct(of_line, line) >> np.uint64(HASH)).astype(np.int64)
        lines = np.maximum(np.bincount(of_line, minlength=self.n), 1)
        letters = np.maximum(self.per_text(UPPER[raw] | LOWER[raw]), 1)
        doubled = np.zeros(len(raw), bool)
        doubled[1:] = MARK[raw[1:]] & (raw[1:] == raw[:-1])
        lone = first[(last - first == 1) & PART[raw[first]]]
        shares = [
            self.per_text(SIGN[raw]) / words, count(first[ENDING[raw[last - 1]]]) / words, self.per_text(UPPER[raw]) / letters, self.per_text(doubled) / words, count(first[again]) / words, different / words,
            np.where(lines >= 4, 1 - np.bincount(pairs, minlength=self.n) / lines, 0.0), self.per_text(BAR[raw]) / words, count(lone) / words, self.per_text(END[raw]) / words,
            np.bincount(text, (last - first).astype(float), self.n) / words,
        ]
        return np.stack([n.astype(float), *shares], axis=1)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash of HASH bits) of the distinct words and words' beginnings of each text, in order."""
        first, last = self.parts
        text, found, of = self.of(first), [self.word_hashes(first, last)], []
        of.append(text)
        for k in BEGINNINGS:
            long = last - first > k
            found.append(mix64((self.hash[first[long] + k] - self.hash[first[long]]) * self.at.down[first[long]] + np.uint64(k << 32)))
            of.append(text[long])
        keys = _distinct(np.concatenate(of), np.concatenate(found))
        return (keys >> np.uint64(HASH)).astype(np.int64), keys & np.uint64((1 << HASH) - 1)


def grouped(texts: list[str]) -> Iterator[tuple[int, Texts]]:
    at = Powers()
    for first, group in texts_in_groups(texts):
        at.to(sum(map(len, group)) + len(group) + 2)
        yield first, Texts(group, at)


def votes(m: np.ndarray, n_features: np.ndarray, n_toxic: np.ndarray) -> np.ndarray:
    """Patterns of the heuristics' votes: a bit each. n_toxic: features of each text that are toxic, of n_features."""
    n, signs, signed, capitals, doubled, stutter, different, lines, bars, lone, ends, _ = m.T
    cast = [
        n < 8, signs > 0.05, signed > 0.2, (capitals > 0.5) & (n > 2), doubled > 0.1, stutter > 0.3, (n >= 20) & (different < 0.15 * np.maximum(n, 1) ** -0.1) & (different < 0.5),
        lines > 0.4, bars > 0.15, lone > 0.15, (n >= 20) & (ends * 80 < 1), n_toxic >= 3, (n_toxic >= 2) & (n_toxic > 0.004 * n_features),
    ]
    out = np.zeros(len(n), np.int64)
    for i, v in enumerate(cast):
        out |= v.astype(np.int64) << i
    return out


def coarse(m: np.ndarray) -> np.ndarray:
    """Measures in steps: a row a text, of places among len(MEASURES) * STEPS."""
    scaled = np.concatenate([m[:, :1], m[:, 1:-1] * 256, m[:, -1:]], axis=1)
    return np.minimum(np.log2(scaled + 1).astype(np.int64), STEPS - 1) + np.arange(len(MEASURES)) * STEPS


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each x is in known, which is in order."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def patterns(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for _, t in grouped(texts):
        of, h = t.features() if len(toxic) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        n_toxic = np.bincount(of[_member(h, toxic)], minlength=t.n)
        out.append(votes(t.measures(), np.bincount(of, minlength=t.n), n_toxic))
    return np.concatenate(out)


def expectation_maximisation(counts: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """Vote patterns with their counts -> share of poor documents, rates[class, heuristic] of votes, posterior by pattern.

    Two classes, sound and poor; heuristics vote independently given the class. Starts from the patterns with votes
    as poor, in proportion to their number of votes.
    """
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    v = (patterns[:, None] >> np.arange(len(HEURISTICS)) & 1).astype(float)
    post = np.minimum(0.95, 0.02 + 0.5 * v.sum(axis=1))
    share, rates = 0.1, np.full((2, len(HEURISTICS)), 0.1)
    for _ in range(rounds):
        share = float((n * post).sum() / n.sum())
        for c, w in enumerate((n * (1 - post), n * post)):
            rates[c] = (w @ v + 0.01) / (w.sum() + 1)
        # heuristics vote against documents: one that fires more on sound ones tells nothing
        rates[1] = np.maximum(rates[1], rates[0])
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        like = v @ np.log(rates.T) + (1 - v) @ np.log(1 - rates.T)
        odds = like[:, 1] - like[:, 0] + np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved = float((n * np.abs(new - post)).sum() / n.sum())
        post = new
        if moved < 1e-9:
            break
    return share, rates, dict(zip(patterns.tolist(), post.tolist()))


DENSE = len(MEASURES) * STEPS


def fit(rows: list[np.ndarray], steps: np.ndarray, labels: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on hashed features (rows) and coarse measures (steps), by Adagrad on all rows; the bias comes last."""
    if not len(rows):
        return np.zeros(BUCKETS + DENSE + 1)
    row, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    # features that stand in poor texts about as often as in others say nothing, and long texts have many of them
    all_, poor = np.bincount(col, minlength=BUCKETS), np.bincount(col, labels[row], BUCKETS)
    due = all_ * labels.mean()
    tells = (all_ >= LEAST_TOLD) & (np.abs(poor - due) > LEAST_SCORE * np.sqrt(np.maximum(due * (1 - labels.mean()), 1e-9)))
    row, col = row[tells[col]], col[tells[col]]
    used, col = np.unique(col, return_inverse=True)
    wide = len(used)
    w, g2 = np.zeros(wide + DENSE + 1), np.full(wide + DENSE + 1, 1e-8)
    size = np.where(labels > 0.5, 0.5 / max((labels > 0.5).sum(), 1), 0.5 / max((labels <= 0.5).sum(), 1)) * len(labels)
    for _ in range(rounds):
        z = np.bincount(row, w[col], len(rows)) + w[wide + steps].sum(axis=1) + w[-1]
        d = size * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / len(rows)
        g = np.concatenate([np.bincount(col, d[row], wide), np.bincount(steps.ravel(), np.repeat(d, steps.shape[1]), DENSE), [d.sum()]])
        g[:-1] += 1e-4 * w[:-1]
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    out = np.zeros(BUCKETS + DENSE + 1)
    out[used], out[BUCKETS:] = w[:wide], w[wide:]
    return out


def score(texts: list[str], w: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for _, t in grouped(texts):
        of, h = t.features()
        weight = np.bincount(of, w[(h % np.uint64(BUCKETS)).astype(np.int64)], t.n)
        out.append(weight + w[BUCKETS + coarse(t.measures())].sum(axis=1) + w[-1])
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -50, 50)))


def described(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed features and coarse measures of texts, as fit() takes them."""
    rows, steps = [], [np.zeros((0, len(MEASURES)), np.int64)]
    for _, t in grouped(texts):
        of, h = t.features()
        edge = np.searchsorted(of, np.arange(t.n + 1))
        col = (h % np.uint64(BUCKETS)).astype(np.int32)
        rows += [col[a:b] for a, b in zip(edge[:-1], edge[1:])]
        steps.append(coarse(t.measures()))
    return rows, np.concatenate(steps)


def scored(weights: np.ndarray) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    packed = weights.astype(np.float32).tobytes()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.frombuffer(packed, np.float32).astype(float)
        for batch in batches:
            yield pd.Series(score(batch.tolist(), w))

    return run


def _part(column, most: int, count: int):
    """About most of count rows, by a hash of a column: the same in every run."""
    part = min(1.0, most / max(count, 1))
    return F.lit(True) if part == 1 else F.pmod(F.xxhash64(column), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))


def toxic_features(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Hashes of words and beginnings that the labelled sample marks as toxic."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    labels = labels.where(_part("doc_id", MOST_LABELLED, labels.count())).withColumnRenamed("doc_id", "_id")
    # about MOST_LABELLED rows, so always small
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).join(F.broadcast(labels), F.col("doc_id") == F.col("_id")).select("_t", "_toxic")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic = batch["_toxic"].to_numpy()
            for first, t in grouped(batch["_t"].tolist()):
                of, h = t.features()
                yield pd.DataFrame({"h": h.view(np.int64), "toxic": toxic[first + of] > 0})

    seen = some.agg(F.count_if(F.col("_toxic") > 0).alias("toxic"), F.count_if(F.col("_toxic") <= 0).alias("other")).first()
    counts = some.mapInPandas(words, "h long, toxic boolean").groupBy("h").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    often = counts.where((F.col("a") >= max(LEAST_SEEN, LEAST_SHARE * (seen.toxic or 0))) & (F.col("a") * (seen.other or 0) > LEAST_ODDS * (F.col("b") + 0.5) * (seen.toxic or 0)))
    return np.array(sorted(r.h for r in often.select("h").collect()), np.int64).view(np.uint64)  # of the sample: bounded with it


def train(docs: DataFrame, labels: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """The scorer's weights, the heuristics' estimated rates of votes by class, and the share of poor documents."""
    toxic = np.zeros(0, np.uint64) if labels is None else toxic_features(docs, labels)
    text = docs.select(F.coalesce("text", F.lit("")).alias("_t"))

    def votes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"pattern": patterns(batch["_t"].tolist(), toxic)})

    counts = text.mapInPandas(votes_of, "pattern long").groupBy("pattern").count().collect()  # at most 2^13 patterns
    counts = {r["pattern"]: r["count"] for r in counts}
    if not counts:
        return np.zeros(BUCKETS + DENSE + 1), np.zeros((2, len(HEURISTICS))), 0.0
    share, rates, posterior = expectation_maximisation(counts)
    chosen = text.where(_part("_t", MOST_TRAINED, sum(counts.values())))

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_t"].tolist()
            rows, steps = described(texts)
            yield pd.DataFrame({"h": pd.util.hash_array(batch["_t"].to_numpy(object)).view(np.int64), "label": [posterior[p] for p in patterns(texts, toxic).tolist()], "f": [r.tobytes() for r in rows], "s": list(steps)})

    sample = chosen.mapInPandas(rows_of, "h long, label double, f binary, s array<long>").orderBy("h").limit(2 * MOST_TRAINED).collect()
    rows, steps, marks, total = [], [], [], 0
    for r in sample:
        total += len(r.f) // 4
        if total > MOST_FEATURES:
            break
        rows.append(np.frombuffer(r.f, np.int32))
        steps.append(r.s)
        marks.append(r.label)
    return fit(rows, np.array(steps, np.int64).reshape(len(rows), len(MEASURES)), np.array(marks)), rates, share


def judge(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs with poor, the probability of poor quality in [0, 1], and kept, whether the document stays.

    labels(doc_id, toxic): a bounded sample of them tells toxic words; of several labels of a document the worst counts,
    null ones do not; without any, the two heuristics on such words never vote. A null text is judged as an empty one,
    and a text without words is poor. Repeated rows get equal results; rows are judged by their text alone, so null ids
    do not matter. Columns poor and kept of docs are replaced, others stay. The result has each row of docs, of an
    empty table none.
    """
    small_batches(docs.sparkSession)
    weights, _, _ = train(docs, labels)
    poor = F.pandas_udf(scored(weights), "double")
    out = docs.withColumn("poor", poor(F.coalesce("text", F.lit(""))))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return out.withColumn("poor", F.when(blank, F.lit(1.0)).otherwise(F.round("poor", 6))).withColumn("kept", F.col("poor") <= REJECT)


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, poor, kept."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))[["doc_id", "poor", "kept"]]
