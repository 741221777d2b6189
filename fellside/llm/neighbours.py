"""Operator 13, nearest neighbours by randomly rotated one-bit codes.

*Index.* Centres are fitted by k-means on a sample of about ``SAMPLE`` vectors, the rotation is drawn from a seed; then every vector is encoded: its nearest
centre, the length of what parts it from there, the signs of that rest after the rotation (a bit a dimension) and the inner product of the rest's direction with its
code's. Equal vectors are one entry with the ``copies`` least identifiers; ties go to lesser identifiers, so no other copy is in any result of fewer. Entries are sorted over
the cluster by centre and hash and packed into blocks of one centre, so that a crowded centre has many blocks in many tasks.

*Search.* A set of queries (``QUERIES`` at most; more take further rounds) goes to all tasks, each with some of the blocks. The inner product of query and vector is estimated from
the signs, corrected by that scalar; the estimate's error is bounded by ``SURE`` standard deviations. Only vectors whose least possible distance doesn't exceed the k-th
greatest possible, or the k-th distance found, are compared on their originals, in double precision. A block farther from a query than its k-th
distance, by its centre and longest rest, isn't looked at. The bound fails for one pair in some millions, so that recall is practically one; it's measured in tests.

Work grows with queries times vectors, as nearness in many dimensions demands without giving up recall, at a bit a dimension; memory doesn't grow: a block, a round's queries and k results each.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an identifier, nor vectors of other than the most frequent
length (of equally frequent ones the least); rows alike in identifier and vector are one; a query is every further row whose identifier ``divisor`` divides; candidates exclude all rows
with the query's identifier; an empty table gives no rows; other columns aren't looked at."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, ship, table, written

SAMPLE = 1 << 16
PER_CENTRE = 1024
CENTRES = 1 << 12
BLOCK = 2048
QUERIES = 1 << 13
#: Queries compared with a block at once, and pairs compared exactly at once.
TOGETHER = 256
PAIRS = 1 << 15
SURE = 5.0
SEED = 20

_CODED = "centre int, spread long, ids array<long>, code binary, rest double, agree double, vector array<double>"
_BLOCKS = "centre int, ids array<array<long>>, codes binary, rests array<double>, agrees array<double>, vectors binary"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    lengths = (centres**2).sum(1)
    return np.concatenate([(lengths - 2 * vectors[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(vectors), 4096)]) if len(vectors) else np.empty(0, np.int64)


def fitted(sample: np.ndarray, k: int, steps: int = 8, seed: int = SEED) -> np.ndarray:
    """k-means centres; a centre without vectors stays where it is."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(steps):
        at = nearest(sample, centres)
        counts = np.bincount(at, minlength=len(centres))
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(sample[order], np.append(0, np.cumsum(counts))[:-1][counts > 0]) if len(sample) else sample
        centres[counts > 0] = sums / counts[counts > 0, None]
    return centres


def encode(vectors: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centre, packed signs, length of the rest, and inner product of the rest's direction with its code's, of each vector."""
    at = nearest(vectors, centres)
    rest = vectors - centres[at]
    length = np.sqrt((rest**2).sum(1))
    turned = rest @ turn / np.where(length > 0, length, 1)[:, None]
    agree = np.where(length > 0, np.abs(turned).sum(1) / math.sqrt(vectors.shape[1]), 1.0)
    return at, np.packbits(turned > 0, axis=1), length, agree


@dataclass
class Index:
    blocks: DataFrame
    centres: np.ndarray
    turn: np.ndarray


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, vector) that take part, each once; written."""
    rows = picked(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows, _ = written(rows.where(F.col("id").isNotNull() & fine).withColumn("dims", F.size("vector")), "vectors")
    sizes = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    return rows.where(F.col("dims") == (sizes[0].dims if sizes else 0)).select("id", "vector")


def _key():
    return F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")


def _encoded(dims: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turn = model.value
        for b in batches:
            if len(b):
                vectors = b.column(2)
                at, codes, length, agree = encode(_matrix(vectors, dims), centres, turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(agree), vectors], [x.split()[0] for x in _CODED.split(", ")])

    return run


def _packed(dims: int):
    """Sorted by centre: rows to blocks of one centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def block():
            t = pa.Table.from_batches(waiting).combine_chunks()
            lists = lambda c: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).combine_chunks())
            codes = b"".join(t.column("code").to_pylist())
            vectors = _matrix(t.column("vector").combine_chunks(), dims).tobytes()
            return pa.RecordBatch.from_arrays([t.column("centre").combine_chunks()[:1], lists("ids"), pa.array([codes], pa.binary()), lists("rest"), lists("agree"), pa.array([vectors], pa.binary())], [x.split()[0] for x in _BLOCKS.split(", ")])

        for b in batches:
            centres = b.column(0).to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(centres[1:] != centres[:-1]) + 1, len(b))
            lo = 0
            for hi in cuts.tolist():
                while lo < hi:
                    if waiting and (size >= BLOCK or waiting[0].column(0)[0].as_py() != centres[lo]):
                        yield block()
                        waiting, size = [], 0
                    n = min(hi - lo, BLOCK - size)
                    waiting.append(b.slice(lo, n))
                    size, lo = size + n, lo + n
        if waiting:
            yield block()

    return run


def build_index(rows: DataFrame, copies: int) -> Index | None:
    """``rows``: from :func:`usable`. ``copies``: how many identifiers of equal vectors are kept, the least first."""
    spark = rows.sparkSession
    ship(spark)
    count = rows.count()
    if not count:
        return None
    keyed = rows.withColumns(dict(zip(("k1", "k2"), _key(), strict=True)))
    least = Window.partitionBy("k1", "k2").orderBy("id")
    kept = keyed.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= copies)
    entries, _ = written(kept.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.any_value("vector").alias("vector")).select(F.col("k1").alias("spread"), "ids", "vector"), "entries")
    share = min(1.0, SAMPLE / count)
    sample = entries.where(F.pmod(F.xxhash64("spread", F.lit(SEED)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("vector").toArrow().column(0).combine_chunks()
    dims = len(rows.first().vector)
    sample = _matrix(sample, dims) if len(sample) else np.zeros((1, dims))
    centres = fitted(sample, max(1, min(CENTRES, count // PER_CENTRE, len(sample))))
    turn = rotation(dims)
    coded = entries.mapInArrow(_encoded(dims, spark.sparkContext.broadcast((centres, turn))), _CODED)
    blocks, _ = written(coded.repartitionByRange("centre", "spread").sortWithinPartitions("centre", "spread").mapInArrow(_packed(dims), _BLOCKS), "codes")
    return Index(blocks, centres, turn)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, row by row, summed from the first component to the last."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += (x - y) ** 2
    return np.sqrt(total)


def bounds(turned: np.ndarray, apart: np.ndarray, codes: np.ndarray, rests: np.ndarray, agrees: np.ndarray, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of queries (rotated, from the centre; ``apart``: their lengths) to encoded vectors."""
    dims = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * np.float32(2) - np.float32(1)
    product = (turned.astype(np.float32) @ signs.T).astype(np.float64) / math.sqrt(dims) / agrees
    about = rests**2 + apart[:, None] ** 2 - 2 * rests * product
    deviation = np.sqrt(np.maximum(0, 1 - agrees**2)) / agrees / math.sqrt(max(1, dims - 1))
    error = apart[:, None] * (2 * rests * (sure * deviation + 1e-5)) + 1e-9 * (rests**2 + apart[:, None] ** 2)
    return about - error, about + error


class Best:
    """The k nearest of each query, of all that was added; equal distances by identifier."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.q, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.limit = np.full(queries, np.inf)

    def add(self, q, ids, score) -> None:
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = nth < self.k
        full = nth == self.k - 1
        self.limit[q[full]] = score[full]
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]


def _near(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, own, queries, centres, turn = asked.value
        dims = queries.shape[1]
        turned_queries, turned_centres = queries @ turn, centres @ turn
        best = Best(len(numbers), k)
        for b in batches:
            for i in range(len(b)):
                centre = b.column(0)[i].as_py()
                ids = b.column(1)[i].values
                starts, ids = ids.offsets.to_numpy().astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False)
                starts = starts - starts[0]
                rests, agrees = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                codes = np.frombuffer(b.column(2)[i].as_py(), np.uint8).reshape(len(rests), -1)
                vectors = np.frombuffer(b.column(5)[i].as_py(), np.float64).reshape(-1, dims)
                apart = np.sqrt(((queries - centres[centre]) ** 2).sum(1))
                least = np.maximum(apart - rests.max(), rests.min() - apart)
                open_ = np.flatnonzero(least * (1 - 1e-9) <= best.limit)
                for lo in range(0, len(open_), TOGETHER):
                    some = open_[lo : lo + TOGETHER]
                    low, high = bounds(turned_queries[some] - turned_centres[centre], apart[some], codes, rests, agrees)
                    limit = best.limit[some] ** 2 * (1 + 1e-9)
                    if len(rests) > k:  # one of them may be the query itself
                        limit = np.minimum(limit, np.partition(high, k, axis=1)[:, k])
                    q, v = np.nonzero(low <= limit[:, None])
                    for at in range(0, len(q), PAIRS):
                        qs, vs = some[q[at : at + PAIRS]], v[at : at + PAIRS]
                        score = distances(vectors[vs], queries[qs])
                        near = score <= best.limit[qs]
                        qs, vs, score = qs[near], vs[near], score[near]
                        n = starts[vs + 1] - starts[vs]
                        each = np.repeat(np.arange(len(vs)), n)
                        place = np.repeat(starts[vs] - np.cumsum(n) + n, n) + np.arange(len(each))
                        other = ids[place] != own[qs[each]]
                        each, place = each[other], place[other]
                        best.add(qs[each], ids[place], score[each])
        if len(best.q):
            yield pa.RecordBatch.from_arrays([pa.array(numbers[best.q]), pa.array(own[best.q]), pa.array(best.id), pa.array(best.score)], ["q", "query_id", "vec_id", "score"])

    return run


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """``queries``: rows (q, id, vector), written. Rows (query_id, rank, vec_id, score)."""
    spark = queries.sparkSession
    rounds = max(1, math.ceil(queries.count() / QUERIES))
    found = None
    for i in range(rounds):
        some = queries.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == i).toArrow().combine_chunks()  # about QUERIES rows
        if len(some):
            numbers, own = (some.column(c).to_numpy() for c in ("q", "id"))
            sent = spark.sparkContext.broadcast((numbers, own, _matrix(some.column("vector").combine_chunks(), len(index.turn)), index.centres, index.turn))
            near = index.blocks.mapInArrow(_near(sent, k), "q long, query_id long, vec_id long, score double")
            found = near if found is None else found.union(near)
    if found is None:
        found = spark.createDataFrame([], "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, k: int = 10, divisor: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of every row whose identifier ``divisor`` divides."""
    rows = usable(vectors, id_col, vector_col)
    index = build_index(rows, k + 1)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(F.col("id") % divisor == 0).dropDuplicates(["id", "vector"])
    queries, _ = written(asked.select(F.monotonically_increasing_id().alias("q"), "id", "vector"), "queries")
    return search(index, queries, k)


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, LAMBDA x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, LAMBDA x: x <> 0)) > 0),
d AS (SELECT len(v) AS dims FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT e.*, row_number() OVER () AS q FROM e, d WHERE len(v) = dims),
p AS (SELECT a.q, a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS score FROM f a JOIN f b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, vec_id) AS nth FROM p)
SELECT query_id, nth::INTEGER AS rank, vec_id, score FROM o WHERE nth <= 10
"""
