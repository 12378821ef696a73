"""Near-duplicate detection with weighted MinHash signatures of word-shingle multisets.

A document is a multiset of 5-word shingles. For a shingle that occurs c times, dyadic intervals of the weight axis,
(0,1], (1,2], (2,4], ..., each carry a Poisson process seeded by the shingle and the interval; a point has a time, a
unit of weight inside its interval and a slot of the signature, and counts if its unit is at most c. A slot keeps the
earliest time. Two documents agree in a slot with probability sum(min)/sum(max) of their counts, without bias, and the
cost of a shingle follows log c, not c. Slots are banded. In each band's bucket all members meet the one that meets most
others; then, in buckets that still hold two classes, all members meet in blocks, on a sketch of a byte a slot. Those that
the sketch does not rule out meet once more with their multisets; a task verifies their pairs and gives only the links that
join two of its classes, so its result grows with its members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import discard, settle, small_batches, table
from veilframe.llm.components import components
from veilframe.llm.hashing import Powers, mix64, shingles, texts_in_groups, word_hashes

SHINGLE, SIMILAR = 5, 0.8
#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
#: Candidates are sent to executors whole up to so many rows (24 bytes each), else joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Members of a bucket meet in blocks of about so many, with about so many bytes of multisets; a bucket's members meet its hub dealt by a salt.
BLOCK, BLOCK_BYTES, SALTS = 4096, 32 << 20, 16
SIGNATURE = "_k long, _h long, n_words long, s1 long, s2 long, bands array<long>, sketch binary"


def least_agreeing(miss: float = 1e-6) -> int:
    """Slots that agree at least in a pair of similarity SIMILAR, but with a probability of miss."""
    n, tail, k = BANDS * ROWS, 0.0, 0
    while True:
        tail += math.comb(n, k) * SIMILAR**k * (1 - SIMILAR) ** (n - k)
        if tail > miss:
            return k
        k += 1


#: Pairs whose sketches agree in fewer slots are ruled out.
AGREE = least_agreeing()


def bag_signature(items: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """The earliest time in each slot over all accepted points of a non-empty multiset."""
    total = float(counts.sum())
    until = slots * (np.log(slots) + 6) / total
    while True:
        best = np.full(slots, np.inf)
        level, low, width = 0, 0, 1
        while True:
            alive = counts > low
            if not alive.any():
                break
            seed = mix64(items[alive] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
            most, now, at = counts[alive], np.zeros(int(alive.sum())), 0
            mean = until * width
            step = int(mean + 3 * np.sqrt(mean)) + 2
            while len(seed):
                nth = np.arange(at + 1, at + step + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
                r = mix64(seed[:, None] + nth[None, :])
                gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
                time = now[:, None] + np.cumsum(gap, axis=1)
                q = mix64(r ^ np.uint64(0xA0761D6478BD642F))
                ok = time <= until
                if width > 1:
                    unit = low + 1 + ((q >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
                    ok &= unit <= most[:, None]
                slot = ((q & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)
                np.minimum.at(best, slot[ok].astype(np.int64), time[ok])
                more = time[:, -1] <= until
                seed, most, now, at = seed[more], most[more], time[more, -1], at + step
            low, width, level = (1, 1, 1) if level == 0 else (low * 2, width * 2, level + 1)
        if np.isfinite(best).all():
            return best
        until *= 2


def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at = Powers()
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        ks, hs, texts = batch["_k"].to_numpy(), batch["_h"].to_numpy(), batch["_t"].tolist()
        for first, group in texts_in_groups(texts):
            rows = []
            for i, data in enumerate(group, first):
                words = word_hashes(data, at)
                place = at.to(len(words) + 1)
                s1 = int((words * place.up[: len(words)]).sum(dtype=np.uint64))
                s2 = int((mix64(words + np.uint64(1)) * place.down[: len(words)]).sum(dtype=np.uint64))
                bands, sketch = np.zeros(0, np.int64), b""
                if len(words):
                    items, counts = np.unique(shingles(words, SHINGLE), return_counts=True)
                    best = bag_signature(items, counts, BANDS * ROWS).view(np.uint64).reshape(BANDS, ROWS)
                    bands = salt.copy()
                    for j in range(ROWS):
                        bands = mix64(bands ^ best[:, j])
                    bands, sketch = bands.view(np.int64), (mix64(best.ravel()) >> np.uint64(56)).astype(np.uint8).tobytes()
                rows.append((ks[i], hs[i], len(words), *np.array([s1, s2], np.uint64).view(np.int64), bands, sketch))
            yield pd.DataFrame(rows, columns=["_k", "_h", "n_words", "s1", "s2", "bands", "sketch"])


def multisets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at = Powers()
    for batch in batches:
        rows = []
        for uid, text in zip(batch["uid"], batch["_t"]):
            items, counts = np.unique(shingles(word_hashes((text or "").encode(), at), SHINGLE), return_counts=True)
            rows.append((uid, items.tobytes(), counts.astype(np.uint32).tobytes()))
        yield pd.DataFrame(rows, columns=["uid", "items", "counts"])


def meeting(key: np.ndarray, side: np.ndarray, cross: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: np.ndarray, band: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with one key (neighbours have it) that have different roots, fitting sizes, agreeing sketches, and meet in no band before this one.

    cross: the key's rows are of two blocks, and only rows of different sides meet.
    """
    end = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    end = end[np.searchsorted(end, np.arange(len(key)), side="right")]
    rows, lag, left, right = np.arange(len(key)), 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    before = np.arange(bands.shape[1])
    while True:
        rows = rows[rows + lag < end[rows]]
        if not len(rows):
            return np.concatenate(left), np.concatenate(right)
        other = rows + lag
        low, high = np.minimum(size[rows], size[other]), np.maximum(size[rows], size[other])
        may = (root[rows] != root[other]) & (low >= SIMILAR * high) & (~cross[rows] | (side[rows] != side[other]))
        a, b = rows[may], other[may]
        for i in range(0, len(a), 20_000):
            x, y = a[i : i + 20_000], b[i : i + 20_000]
            near = (sketch[x] == sketch[y]).sum(axis=1) >= AGREE
            x, y = x[near], y[near]
            first = ~((bands[x] == bands[y]) & (before[None, :] < band[x, None])).any(axis=1)
            left.append(x[first])
            right.append(y[first])
        lag += 1


def keys_of(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """work on the rows of whole keys band, value, i and j, in their order. A key has the rows of two blocks at most."""
    left = None
    for batch in batches:
        batch = batch if left is None else pd.concat([left, batch], ignore_index=True)
        last = (batch[PLACE] == batch[PLACE].iloc[-1]).all(axis=1).to_numpy() if len(batch) else np.zeros(0, bool)
        left, ready = batch[last], batch[~last]
        if len(ready):
            yield work(ready)
    if left is not None and len(left):
        yield work(left)


PLACE = ["band", "value", "i", "j"]


def _met(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    key = part.groupby(PLACE, sort=False).ngroup().to_numpy()
    bytes_of = lambda c, kind: np.frombuffer(b"".join(part[c]), kind).reshape(len(part), -1)
    return meeting(key, part["side"].to_numpy(), (part["i"] != part["j"]).to_numpy(), part["root"].to_numpy(), part["size"].to_numpy(), bytes_of("sketch", np.uint8), part["band"].to_numpy(), np.stack(part["bands"].to_list()))


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Uids of the rows that meet a row which the sketches do not rule out."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"uid": np.unique(part["uid"].to_numpy()[np.concatenate(_met(part))])})

    return keys_of(batches, work)


def overlaps(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether a multiset (items in order, counts) is similar to each of others: sum of smaller counts over sum of larger ones."""
    items, counts = one
    sizes = np.array([len(x) for x, _ in others])
    its, cts = np.concatenate([x for x, _ in others]), np.concatenate([c for _, c in others])
    at = np.searchsorted(items, its)
    at[at == len(items)] = 0
    begin = np.cumsum(sizes) - sizes
    both = np.add.reduceat(np.where(items[at] == its, np.minimum(counts[at], cts), 0), begin)
    return both >= SIMILAR * (counts.sum() + np.add.reduceat(cts, begin) - both)


def _bags(items: pd.Series, counts: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(i, np.uint64), np.frombuffer(c, np.uint32).astype(np.int64)) for i, c in zip(items, counts)]


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of rows with multisets: similar pairs, as many as join all rows that similar pairs join."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        a, b = _met(part)
        uid, bags, out = part["uid"].to_numpy(), _bags(part["items"], part["counts"]), []
        # classes of the task, the rows of one root together from the start
        of = np.unique(part["root"].to_numpy(), return_inverse=True)[1]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for part_of in np.split(np.arange(len(a)), np.flatnonzero(a[1:] != a[:-1]) + 1) if len(a) else ():
            x, ys = a[part_of[0]], b[part_of]
            ys = ys[of[ys] != of[x]]
            if not len(ys):
                continue
            for y in ys[overlaps(bags[x], [bags[y] for y in ys])]:
                if of[y] != of[x]:
                    out.append((uid[x], uid[y]))
                    of[of == of[y]] = of[x]
        return pd.DataFrame(out, columns=["a", "b"])

    return keys_of(batches, work)


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose multisets overlap enough."""
    for batch in batches:
        keep = [bool(overlaps(a, [b])[0]) for a, b in zip(_bags(batch["items_a"], batch["counts_a"]), _bags(batch["items_b"], batch["counts_b"]))]
        yield batch.loc[keep, ["a", "b"]]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _k, its id with null last, _t, its text with null as empty, and _h, a hash of the text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_k"), F.xxhash64(text).alias("_h"), text.alias("_t"))


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Multisets of the wanted(uid, _k, _h) documents. Repeated rows have the same key and the same multiset."""
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, ["_k", "_h"]).select("uid", "_t")
    return found.mapInPandas(multisets, "uid long, items binary, counts binary").dropDuplicates(["uid"])


def _multisets(docs: DataFrame, keys: DataFrame, uids: DataFrame) -> DataFrame:
    return settle(_fetch(docs, settle(keys.join(uids, "uid").select("uid", "_k", "_h"), "wanted")), "multisets")


def _links(docs: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs(a, b) that are similar enough."""
    pairs = settle(pairs, "pairs")
    old = pairs
    ends = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    sets = _multisets(docs, keys, ends)
    for end in ("a", "b"):
        side = sets.select(F.col("uid").alias(end), F.col("items").alias(f"items_{end}"), F.col("counts").alias(f"counts_{end}"))
        pairs = pairs.join(side, end)
    links = settle(pairs.mapInPandas(verified, "a long, b long"), "links")
    for done in (old, sets):
        discard(done)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(_k, _h, n_words, uid, class_k): a row for each row of docs; class_k is the smallest _k of its class.

    Documents with the same sequence of words are copies, one of which stands for all. Those whose 5-word shingle
    multisets have a weighted Jaccard similarity of at least 0.8 are linked; classes are the components of the links.
    Classes are those of all pairs that meet in a band: a pair of one bucket is left out only if both are in one class
    already, their sizes differ too much, or their sketches agree in too few slots (which a similar pair does once in a
    million).

    A text of fewer than five words has one shingle, of all its words. Texts without words (null, empty, blank)
    are copies of each other. Null ids rank after all others. Repeated rows share a class. Very long texts are read
    whole. An empty table gives an empty result. Extra columns are ignored.
    """
    d = keyed(docs)
    sig = settle(d.mapInPandas(signatures, SIGNATURE).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    same, bucket = ["s1", "s2", "n_words"], ["band", "value"]
    reps = settle(sig.groupBy(*same).agg(F.min(F.struct("_k", "uid", "_h", "bands", "sketch")).alias("rep")).select(*same, "rep.*"), "copies")
    cells = reps.select("uid", F.greatest(F.col("n_words") - SHINGLE + 1, F.lit(1)).alias("size"), F.posexplode("bands").alias(*bucket))
    shared = cells.groupBy(*bucket).agg(F.count("*").alias("met")).where("met > 1")
    members = settle(cells.join(shared, bucket), "buckets")
    keys = reps.select("uid", "_k", "_h")

    def rooted(df: DataFrame, roots: DataFrame, of: str, out: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(of), F.col("root").alias(out)), of, "left").withColumn(out, F.coalesce(out, of))

    # each bucket's member that meets most others meets all of them
    met = members.groupBy("uid").agg(F.sum("met").alias("all"))
    hubs = members.join(met, "uid").groupBy(*bucket).agg(F.max(F.struct("all", F.col("uid").alias("hub"), F.col("size").alias("hub_size"))).alias("h")).select(*bucket, "h.*")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = members.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(hubs, [*bucket, "salt"]).where("uid <> hub")
    # the overlap is at most the smaller size, the union at least the larger one
    pairs = pairs.where(F.least("size", "hub_size") >= F.lit(SIMILAR) * F.greatest("size", "hub_size"))
    links = _links(d, keys, pairs.select(F.least("uid", "hub").alias("a"), F.greatest("uid", "hub").alias("b")).distinct())
    roots = settle(components(links), "roots")

    # members of buckets that still hold two classes meet in blocks; a block's members are copied to each pair of blocks that it is in
    live = settle(rooted(members, roots, "uid", "root").drop("met"), "live")

    def in_blocks(rows: DataFrame) -> DataFrame:
        apart = rows.groupBy(*bucket).agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.greatest(F.count("*") / BLOCK, F.sum(F.col("size") * 12) / BLOCK_BYTES).alias("_n")).where("_low <> _high")
        out = rows.join(apart.select(*bucket, F.ceil("_n").cast("int").alias("blocks")), bucket)
        out = out.withColumn("side", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        out = out.select(*bucket, F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "side", "uid", "root", "size")
        return out.join(reps.select("uid", "sketch", "bands"), "uid")

    dealt = lambda rows: rows.repartition(*PLACE).sortWithinPartitions(*PLACE)
    near = settle(dealt(in_blocks(live)).mapInPandas(compared, "uid long").distinct(), "near")
    if near.take(1):
        sets = _multisets(d, keys, near)
        links = settle(dealt(in_blocks(live.join(near, "uid", "left_semi")).join(sets, "uid")).mapInPandas(joined, "a long, b long"), "links")
        links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = settle(components(links), "roots")

    reps = rooted(reps.select(*same, "uid", F.col("_k").alias("rep_k")), roots, "uid", "root")
    least = reps.groupBy("root").agg(F.min("rep_k").alias("class_k"))
    classes = settle(reps.join(least, "root").select(*same, "class_k"), "classes")
    return sig.select("_k", "_h", "uid", *same).join(classes, same).drop("s1", "s2")


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_words."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    none = F.lit(2**63 - 1)
    return found.select(F.nullif("_k", none).alias("doc_id"), F.nullif("class_k", none).alias("class_id"), "n_words")
