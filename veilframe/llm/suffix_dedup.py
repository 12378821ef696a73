"""Removing later copies of passages with longest-previous-factor arrays, without gathering the corpus.

A byte goes if a 100-byte string that covers it also starts earlier in the corpus. All suffixes of all documents are
far too many to sort, so suffixes meet only where they can match:

1. Every 100-byte window has one anchor, its 32-byte string of smallest hash (the leftmost of equals). Equal windows
   have equal anchors at equal offsets. The consecutive windows of one anchor form a stretch of at most 168 bytes.
2. Stretches are dealt by anchor, those of hot anchors by their own hash. Of equal stretches all but the first are copies
   outright, and tasks settle this among their own rows before the shuffle, so a passage shared by a third of all
   documents sends few rows.
3. Where an anchor has several different stretches, those suffixes whose 100 bytes recur by hash are put in suffix order.
   One pass each way finds every suffix's previous and next smaller position in that order; the longer common prefix
   with one of the two is its longest previous factor, and a factor of 100 makes it a copy.
4. Hot anchors, with more different stretches than a task should hold, stand at the edges of passages that very many
   documents share. Their windows are dealt on by the hash of their 100 bytes, again settled in tasks first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.bagminhash import keyed
from veilframe.llm.common import settle, table
from veilframe.llm.hashing import Powers, mix64, prefix_hash

LENGTH, GRAM = 100, 32
SLIDE = LENGTH - GRAM + 1
#: Anchors with so many different stretches in about MOST_SAMPLED documents are taken as hot from the start, others from MOST_KINDS on.
HOT, MOST_SAMPLED, MOST_KINDS = 32, 5000, 4096
#: Bytes of text worked on at once in a task; positions inside must fit PLACE bits.
CHUNK, PLACE = 1 << 20, 21
PLACED = ("key", "ctx", "_k", "_h", "pos")
STRETCH = "key long, ctx long, _k long, _h long, pos long, cnt int, off int, done boolean, hot boolean, deal long"


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """least[i] = min(x[i : i + width])."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def _pieces(batch: pd.DataFrame) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Groups of (k, h, first byte, bytes): texts of at least LENGTH bytes, long ones cut into overlapping pieces."""
    group, size = [], 0
    for k, h, text in zip(batch["_k"].tolist(), batch["_h"].tolist(), batch["_t"]):
        data = text.encode()
        for start in range(0, max(len(data) - LENGTH + 1, 0), CHUNK - LENGTH + 1):
            piece = data[start : start + CHUNK]
            if group and size + len(piece) > CHUNK:
                yield group
                group, size = [], 0
            group.append((k, h, start, piece))
            size += len(piece)
    if group:
        yield group


def _repeated(*columns: np.ndarray) -> np.ndarray:
    """Rows equal to the one before: a stretch of a repeated row is not a copy of itself."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def stretches(batches: Iterator[pd.DataFrame], hot: np.ndarray = np.zeros(0, np.uint64)) -> Iterator[pd.DataFrame]:
    """The stretches of texts, settled among themselves. hot: keys in order whose stretches are dealt by their own hash."""
    at = Powers()
    low = np.uint64((1 << PLACE) - 1)
    for batch in batches:
        for group in _pieces(batch):
            data = np.frombuffer(b"".join(x[3] for x in group), np.uint8)
            sizes = np.array([len(x[3]) for x in group])
            begin = np.cumsum(sizes) - sizes
            p = prefix_hash(data, at)
            n = len(data) - GRAM + 1
            gram = mix64((p[GRAM:] - p[:n]) * at.down[:n])
            anchor = (sliding_least((gram & ~low) | np.arange(n, dtype=np.uint64), SLIDE) & low).astype(np.int64)
            starts = np.concatenate([np.arange(b, b + s - LENGTH + 1) for b, s in zip(begin, sizes)])
            anchor = anchor[starts]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            cnt = np.diff(np.append(first, len(starts)))
            s, a = starts[first], anchor[first]
            piece = np.searchsorted(begin, s, side="right") - 1
            k, h = np.array([x[0] for x in group])[piece], np.array([x[1] for x in group])[piece]
            pos = s - begin[piece] + np.array([x[2] for x in group])[piece]
            key = gram[a]
            ctx = mix64((p[s + cnt + LENGTH - 1] - p[s]) * at.down[s] + mix64(((a - s) * LENGTH + cnt).astype(np.uint64)))
            order = np.lexsort((pos, h, k, ctx, key))
            order = order[~_repeated(key[order], ctx[order], k[order], h[order], pos[order])]
            again = np.zeros(len(key), bool)
            again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (ctx[order[1:]] == ctx[order[:-1]])
            # copies found here: neighbouring stretches of a document become one
            d = np.flatnonzero(again)
            glued = np.zeros(len(d), bool)
            glued[1:] = (k[d[1:]] == k[d[:-1]]) & (h[d[1:]] == h[d[:-1]]) & (pos[d[1:]] == pos[d[:-1]] + cnt[d[:-1]]) & (piece[d[1:]] == piece[d[:-1]])
            head = np.flatnonzero(~glued)
            total = np.add.reduceat(cnt[d], head) if len(d) else cnt[:0]
            u, h0 = order[~again[order]], d[head]
            rows = np.concatenate([u, h0])
            keys, done = np.concatenate([key[u], mix64(ctx[h0])]), np.arange(len(rows)) >= len(u)
            warm = ~done & member(keys, hot)
            yield pd.DataFrame({
                "key": keys.view(np.int64), "ctx": ctx[rows].view(np.int64), "_k": k[rows], "_h": h[rows], "pos": pos[rows], "cnt": np.concatenate([cnt[u], total]).astype(np.int32),
                "off": (a - s)[rows].astype(np.int32), "done": done, "hot": warm, "deal": np.where(warm, mix64(ctx[rows]), keys).view(np.int64),
            })


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each x is in known, which is in order."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches with their bytes -> their windows as stretches of one, keyed by the hash of their bytes; of equal ones in a batch all but the first are done."""
    at = Powers()
    for batch in batches:
        for i in range(0, len(batch), 2000):
            part = batch[i : i + 2000]
            data, cnt = np.frombuffer(b"".join(part["data"]), np.uint8), part["cnt"].to_numpy().astype(np.int64)
            sizes = part["data"].map(len).to_numpy()
            row = np.repeat(np.arange(len(part)), cnt)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            start = (np.cumsum(sizes) - sizes)[row] + nth
            p = prefix_hash(data, at)
            key = mix64((p[start + LENGTH] - p[start]) * at.down[start])
            k, h, pos = part["_k"].to_numpy()[row], part["_h"].to_numpy()[row], part["pos"].to_numpy()[row] + nth
            order = np.lexsort((pos, h, k, key))
            order = order[~_repeated(key[order], k[order], h[order], pos[order])]
            done = np.zeros(len(order), bool)
            done[1:] = key[order[1:]] == key[order[:-1]]
            key = np.where(done, mix64(key[order] + pos[order].view(np.uint64)), key[order]).view(np.int64)
            yield pd.DataFrame({"key": key, "ctx": key, "_k": k[order], "_h": h[order], "pos": pos[order], "cnt": np.int32(1), "off": np.int32(0), "done": done, "hot": False, "deal": key})


def sifted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of key, ctx and position -> copies (done), and the first stretch of each kind where a key has several or is hot.

    Keeps one row between batches, so a key may have any number of rows.
    """
    held, last, paired = None, None, False
    for batch in batches:
        yield batch[batch["done"]]
        live = batch[~batch["done"]]
        live = live[~_repeated(*(live[c].to_numpy() for c in PLACED))]
        if last is not None and len(live) and tuple(live.iloc[0][list(PLACED)]) == last:
            live = live[1:]
        if not len(live):
            continue
        key, ctx = live["key"].to_numpy(), live["ctx"].to_numpy()
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
        if last is not None:
            new[0] = (key[0], ctx[0]) != last[:2]
        last = tuple(live.iloc[-1][list(PLACED)])
        yield live[~new].assign(done=True)
        fresh = live[new]
        yield fresh[fresh["hot"]]
        fresh = fresh[~fresh["hot"]]
        kinds = fresh if held is None else pd.concat([held, fresh])
        if not len(kinds):
            continue
        key = kinds["key"].to_numpy()
        same = np.zeros(len(kinds) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        same[0] = paired and held is not None
        yield kinds[(same[:-1] | same[1:])[:-1].tolist() + [False]] if len(kinds) > 1 else kinds[:0]
        held, paired = kinds[-1:], bool(same[len(kinds) - 1])
    if held is not None and paired:
        yield held


def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of a document's stretches; at: arrays of key, pos, cnt, off in turn."""
    for batch in batches:
        out = []
        for k, h, text, flat in zip(batch["_k"], batch["_h"], batch["_t"], batch["at"]):
            data = text.encode()
            out += [(x["key"], k, h, x["pos"], x["cnt"], data[x["pos"] : x["pos"] + x["cnt"] + LENGTH - 1]) for x in flat]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["key", "_k", "_h", "pos", "cnt", "data"])
                out = []
        yield pd.DataFrame(out, columns=["key", "_k", "_h", "pos", "cnt", "data"])


def smaller_before(place: np.ndarray) -> np.ndarray:
    """For each element the index of the nearest smaller one before it, or -1."""
    out = np.arange(-1, len(place) - 1)
    while True:
        off = np.flatnonzero((out >= 0) & (place[np.maximum(out, 0)] > place))
        if not len(off):
            return out
        out[off] = out[out[off]]  # all between are larger too


def longest_previous(suffix: np.ndarray) -> np.ndarray:
    """Longest-previous-factor array of suffixes, rows of LENGTH bytes in order of position: the longest prefix that also begins an earlier one.

    In suffix order (ties by position) a suffix's longest earlier match is with its previous or its next smaller position.
    """
    n = len(suffix)
    order = np.argsort(np.ascontiguousarray(suffix).view(f"S{LENGTH}").ravel(), kind="stable")
    back = smaller_before(order)
    ahead = n - 1 - smaller_before(order[::-1])[::-1]
    out = np.zeros(n, np.int64)
    for near in (back, ahead):
        ranks = np.flatnonzero((near >= 0) & (near < n))
        for i in range(0, len(ranks), 50_000):
            r = ranks[i : i + 50_000]
            same = suffix[order[r]] == suffix[order[near[r]]]
            common = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
            out[order[r]] = np.maximum(out[order[r]], common)
    return out


def earlier_matches(data: np.ndarray, starts: np.ndarray, at: Powers) -> np.ndarray:
    """For suffixes of data in order of position: is the longest previous factor LENGTH bytes? A suffix whose hash is its own has a shorter one."""
    p = prefix_hash(data, at)
    h = (p[starts + LENGTH] - p[starts]) * at.down[starts]
    order = np.argsort(h)
    near = h[order[1:]] == h[order[:-1]]
    may = np.zeros(len(starts), bool)
    may[order[1:][near]] = may[order[:-1][near]] = True
    out = np.zeros(len(starts), bool)
    if may.any():
        out[may] = longest_previous(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts[may]]) >= LENGTH
    return out


def factored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches in order of key and position -> the runs of windows that have an earlier match."""
    at = Powers()

    def work(part: pd.DataFrame) -> pd.DataFrame:
        sizes = part["data"].map(len).to_numpy()
        begin, cnt = np.cumsum(sizes) - sizes, part["cnt"].to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(part)), cnt)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        hit = earlier_matches(np.frombuffer(b"".join(part["data"]), np.uint8), begin[row] + nth, at)
        hit = np.flatnonzero(hit)
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
        head = np.flatnonzero(fresh)
        length = np.diff(np.append(head, len(hit)))
        r = row[hit[head]]
        return pd.DataFrame({"_k": part["_k"].to_numpy()[r], "_h": part["_h"].to_numpy()[r], "pos": part["pos"].to_numpy()[r] + nth[hit[head]], "cnt": length.astype(np.int32)})

    left = None
    for batch in batches:
        batch = batch if left is None else pd.concat([left, batch], ignore_index=True)
        key = batch["key"].to_numpy()
        end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
        left, ready = batch[end:], batch[:end]
        start = 0
        while start < end:  # whole keys, some thousands of stretches at once
            stop = min(start + 4000, end)
            while stop < end and key[stop] == key[stop - 1]:
                stop += 1
            yield work(ready[start:stop])
            start = stop
    if left is not None and len(left):
        yield work(left)


def hot_anchors(d: DataFrame) -> np.ndarray:
    """Keys of anchors that have many different stretches in a sample of documents. Fewer than the sample's stretches / HOT; only the plan follows from them."""
    count = d.count()
    part = d if count <= MOST_SAMPLED else d.where(F.pmod(F.xxhash64("_k", "_h"), F.lit(1 << 30)) < F.lit(int(MOST_SAMPLED / count * (1 << 30))))
    kinds = part.mapInPandas(stretches, STRETCH).where("not done").groupBy("key", "ctx").count().groupBy("key").count().where(F.col("count") >= HOT)
    return np.sort(np.array([r.key for r in kinds.select("key").collect()], np.int64).view(np.uint64))


def copied_runs(docs: DataFrame) -> DataFrame:
    """(_k, _h, runs): for documents with windows that start earlier too, those windows as start << 31 | number."""
    d = keyed(docs)
    hot = hot_anchors(d)
    order = ["key", "ctx", "_k", "_h", "pos"]
    sift = lambda rows, name: settle(rows.repartition("deal").sortWithinPartitions(*order).mapInPandas(sifted, STRETCH), name)
    found = sift(d.mapInPandas(lambda batches: stretches(batches, hot), STRETCH), "stretches")
    kinds = found.where("not done")
    texts = d.dropDuplicates(["_k", "_h"]) if _repeats(d) else d

    def with_bytes(some: DataFrame, then: Callable | None = None) -> DataFrame:
        """Stretches with their bytes, or what then makes of them in the same worker: one more would hold its memory for stages to come."""
        ask = some.groupBy("_k", "_h").agg(F.collect_list(F.struct("key", "pos", "cnt")).alias("at"))
        asked = texts.join(ask, ["_k", "_h"])
        if then is not None:
            return asked.mapInPandas(lambda batches: then(cut_out(batches)), STRETCH)
        return asked.mapInPandas(cut_out, "key long, _k long, _h long, pos long, cnt int, data binary")

    cold, warm = kinds.where("not hot"), kinds.where("hot")
    many = settle(cold.groupBy("key").count().where(F.col("count") > MOST_KINDS).select("key"), "hot")
    if many.take(1):
        warm, cold = warm.unionByName(cold.join(many, "key", "left_semi")), cold.join(many, "key", "left_anti")
    bits = with_bytes(cold).repartition("key").sortWithinPartitions("key", "_k", "_h", "pos")
    late = bits.mapInPandas(factored, "_k long, _h long, pos long, cnt int")
    runs = found.where("done").select("_k", "_h", "pos", "cnt").unionByName(late)
    if warm.take(1):
        dealt = sift(with_bytes(warm, windows), "windows")
        runs = runs.unionByName(dealt.where("done").select("_k", "_h", "pos", "cnt"))
    return runs.groupBy("_k", "_h").agg(F.collect_set(F.shiftleft("pos", 31).bitwiseOR(F.col("cnt").cast("long"))).alias("_runs"))


def _repeats(d: DataFrame) -> bool:
    """Whether two rows have the same id and text."""
    return bool(d.groupBy("_k", "_h").count().where("count > 1").take(1))


CARVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def carve(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """What is left of a text without its copied windows. Bytes that no longer form a character are not in kept."""
    out = []
    for t, r in zip(text, runs):
        data = (t or "").encode()
        spans: list[list[int]] = []
        for x in np.sort(r).tolist() if r is not None else ():
            start, end = x >> 31, (x >> 31) + (x & (1 << 31) - 1) + LENGTH - 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
        ends = [0, *(e for _, e in spans)]
        kept = b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(data)]))
        out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_copies(docs: DataFrame) -> DataFrame:
    """docs with carved: n_bytes, n_removed, n_spans, kept_sha256 and kept, the text that is left.

    Earlier means a smaller doc_id, or in the same document an earlier start; null ids rank last, and of different
    texts with one id the one with the smaller hash is earlier. Rows with the same id and text count as one document
    and get equal results. Texts of under 100 bytes (null and empty ones too) stay whole; very long ones are read in
    overlapping pieces. A column carved of docs is replaced, all others are kept. An empty table gives an empty result.
    """
    runs = copied_runs(docs)
    k, h = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "carved"]).alias("_row"), k.alias("_k"), h.alias("_h")).join(runs, ["_k", "_h"], "left")
    return rows.withColumn("carved", F.pandas_udf(carve, CARVED)("_row.text", "_runs")).select("_row.*", "carved")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"carved.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
