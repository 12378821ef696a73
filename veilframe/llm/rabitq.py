"""Nearest neighbours by inner product with randomly rotated one-bit codes and exact reranking.

Each vector is split into its length and its direction. The direction is turned by a random frame into a space of at
least 512 dimensions and kept as one bit a dimension, packed, with a correction scalar: the inner product of the turned
direction and its bits' unit vector. A query is turned alike and rounded at random to four bits a dimension, so that the
inner product of a query and a code is a sum of counts of common bits. It estimates the vectors' inner product without
bias, with an error bound that holds with high probability. A vector is reranked exactly if its upper bound reaches the
k-th best so far; what is left out is out of reach but with a probability of WIDTH standard deviations' tail. Each block
of queries meets all candidates, dealt into parts; a task streams its candidates past the queries and keeps only each
query's nearest so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import settle, small_batches, table

NEAREST, EVERY = 20, 20
#: Candidates met at once, queries in a block, rows of a part; half-width of the error bound in standard deviations.
BLOCK, QUERIES, PART, WIDTH = 4096, 8192, 100_000, 4.5
#: Bits of a code at least, bits of a query's numbers; seed of the frame and of the queries' rounding.
BITS, FINE, SEED = 512, 4, 20240521


def frame(dim: int) -> np.ndarray:
    """A random orthonormal frame of dim vectors in the codes' space, whose dimension is a multiple of 64."""
    wide = -(-max(dim, BITS) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((wide, dim)))
    return (q * np.sign(np.diag(r))).T


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows of 64-bit words), correction scalars and lengths of vectors (rows, not zero)."""
    length = np.linalg.norm(vectors, axis=1)
    turned = (vectors / length[:, None]) @ turn
    codes = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
    return codes, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]), length


class Asked:
    """Queries rounded to FINE bits a dimension, as planes of bits."""

    def __init__(self, queries: np.ndarray, turn: np.ndarray) -> None:
        turned = queries @ turn
        self.low = turned.min(axis=1)
        top = (1 << FINE) - 1
        self.step = np.maximum((turned.max(axis=1) - self.low) / top, 1e-300)
        noise = np.random.default_rng(SEED).random(turned.shape)
        level = np.clip(np.floor((turned - self.low[:, None]) / self.step[:, None] + noise), 0, top).astype(np.uint8)
        self.total = level.sum(axis=1, dtype=np.int64)
        self.planes = [np.packbits(level >> b & 1, axis=1, bitorder="little").view(np.uint64) for b in range(FINE)]
        self.dim, self.length = turn.shape[1], np.linalg.norm(queries, axis=1)

    def estimate(self, rows: slice, codes: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of some queries with the unit vectors of codes (words by codes; ones: bits set in each)."""
        common = np.zeros((rows.stop - rows.start, codes.shape[1]), np.int32)
        for b, plane in enumerate(self.planes):
            count = np.zeros(common.shape, np.uint16)
            for w in range(len(codes)):
                count += np.bitwise_count(plane[rows, w, None] & codes[w])
            common += count.astype(np.int32) << b
        # turned query = low + step * level; the code's entries are +-1 / sqrt(dim)
        low, step = self.low[rows, None], self.step[rows, None]
        return (low * (2 * ones[None, :] - self.dim) + step * (2 * common - self.total[rows, None])) / np.sqrt(self.dim)


def half_widths(scalar: np.ndarray, length: np.ndarray, dim: int) -> np.ndarray:
    """Half-widths of the error bounds of estimates with vectors, for a query of length one."""
    return WIDTH * length * np.sqrt(np.maximum(1 - scalar**2, 0)) / scalar / np.sqrt(dim - 1)


def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds dim, code, scalar and length to rows (vec_id, vector)."""
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.array([len(v) // batch["width"].iloc[0] for v in batch["vector"]], np.int32)
        kind = np.float64 if batch["width"].iloc[0] == 8 else np.float32
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.frombuffer(b"".join(batch["vector"].iloc[at]), kind).reshape(-1, dim).astype(np.float64)
            turn = turns.setdefault(int(dim), frame(int(dim)))
            code, scalar, length = encode(x, turn)
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy()[at], "dim": dim, "vector": batch["vector"].iloc[at].to_numpy(), "code": [c.tobytes() for c in code], "scalar": scalar, "length": length})


class Best:
    """The k nearest so far of a block of queries. reranked counts pairs that were scored exactly, of met."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.asked = Asked(queries, frame(queries.shape[1]))
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        self.reach = np.full(len(ids), -np.inf)  # no score below it can be among the k nearest
        self.met = self.reranked = 0

    def meet(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, scalar: np.ndarray, length: np.ndarray) -> None:
        ones = np.bitwise_count(codes).sum(axis=1).astype(np.int64)
        codes, factor, wide = np.ascontiguousarray(codes.T), length / scalar, half_widths(scalar, length, self.asked.dim)
        for first in range(0, len(self.ids), 16):
            rows = slice(first, min(first + 16, len(self.ids)))
            near = self.asked.estimate(rows, codes, ones) * factor
            bound = self.asked.length[rows, None] * wide
            fresh = ~np.isfinite(self.reach[rows])
            if fresh.any():  # the nearest by estimate are scored first, for a reach to hold the others against
                likely = np.argpartition(near, max(0, len(ids) - 2 * self.k), axis=1)[:, -2 * self.k :]
                for j in np.flatnonzero(fresh):
                    self._score(first + j, likely[j], ids, x)
                    near[j, likely[j]] = -np.inf
            may = (near + bound >= self.reach[rows, None]) & (near > -np.inf)
            self.met += may.size
            for j in np.flatnonzero(may.any(axis=1)):
                self._score(first + j, np.flatnonzero(may[j]), ids, x)

    def _score(self, j: int, c: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Score candidates c exactly for query j."""
        c = c[ids[c] != self.ids[j]]
        self.reranked += len(c)
        score = (x[c].astype(np.float64) * self.queries[j]).sum(axis=1)
        some = score >= self.reach[j]
        i, s = np.append(self.found[j][0], ids[c[some]]), np.append(self.found[j][1], score[some])
        top = np.lexsort((i, -s))[: self.k]
        self.found[j] = i[top], s[top]
        if len(top) == self.k:
            self.reach[j] = max(self.reach[j], s[top[-1]])

    def rows(self) -> pd.DataFrame:
        sizes = [len(i) for i, _ in self.found]
        return pd.DataFrame({"query_id": np.repeat(self.ids, sizes), "vec_id": np.concatenate([i for i, _ in self.found]), "score": np.concatenate([s for _, s in self.found])})


def searched(k: int, width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows in order of ask, part and dim, queries before candidates -> the k nearest in the part for each query."""
    kind = np.float64 if width == 8 else np.float32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, asks, best = None, [], None
        for batch in batches:
            for key, rows in batch.groupby(["ask", "part", "dim"], sort=False):
                if key != now:
                    if best is not None:
                        yield best.rows()
                    now, asks, best = key, [], None
                dim = key[2]
                matrix = lambda r: np.frombuffer(b"".join(r["vector"]), kind).reshape(-1, dim)  # noqa: B023, E731
                q = rows[rows["role"] == 0]
                if len(q):
                    asks.append((q["vec_id"].to_numpy(), matrix(q).astype(np.float64)))
                c = rows[rows["role"] == 1]
                if not len(c) or not asks:
                    continue
                if best is None:
                    best = Best(np.concatenate([i for i, _ in asks]), np.concatenate([v for _, v in asks]), k)
                for i in range(0, len(c), BLOCK):
                    part = c[i : i + BLOCK]
                    codes = np.frombuffer(b"".join(part["code"]), np.uint64).reshape(len(part), -1)
                    best.meet(part["vec_id"].to_numpy(), matrix(part), codes, part["scalar"].to_numpy(), part["length"].to_numpy())
        if best is not None:
            yield best.rows()

    return run


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors(vec_id, embedding, ...): the k nearest of each row whose id is divisible by every.

    Nearest is the largest inner product, ties to the smaller id. Vectors that are null, empty, zero or hold a null
    or a non-finite component take no part, nor do rows without an id. Vectors of different lengths never meet. Every other
    row is a candidate, also those that repeat an id; a query meets no row of its own id, and of different query vectors
    with one id the one that sorts first asks. Work grows
    with queries times candidates; each candidate is read once for each block of queries. An empty table gives an empty
    result. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    # single-precision vectors are kept as they are; scores are computed in double precision
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind, width = ("float", 4) if single else ("double", 8)
    vector = F.transform("embedding", lambda x: x.cast(kind))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(fine)
    asking = rows.where(F.col("vec_id") % every == 0)
    repeated = bool(asking.groupBy("vec_id").count().where("count > 1").take(1))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vector": [np.asarray(v, f"f{width}").tobytes() for v in batch["vector"]], "width": width})

    coded = lambda r: r.mapInPandas(lambda batches: encoded(packed(batches)), "vec_id long, dim int, vector binary, code binary, scalar double, length double")
    base = settle(coded(rows), "codes")
    asked = settle(coded(asking.groupBy("vec_id").agg(F.min("vector").alias("vector"))), "asked") if repeated else base.where(F.col("vec_id") % every == 0)
    counts = base.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    # parts are a whole number of times the default parallelism up to PART rows, then as many as it takes
    parts, blocks = max(2 * spark.sparkContext.defaultParallelism, -(-counts[0] // PART)), max(1, -(-counts[1] // QUERIES))
    split = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = asked.select("*", split(blocks).alias("ask"), each(parts).alias("part"), F.lit(0).alias("role"))
    meeting = base.select("*", each(blocks).alias("ask"), split(parts).alias("part"), F.lit(1).alias("role")).unionByName(queries)
    meeting = meeting.repartition("ask", "part").sortWithinPartitions("ask", "part", "dim", "role")
    found = meeting.mapInPandas(searched(k, width), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {NEAREST}"""
