"""Approximate nearest neighbours with a permutation index: pivot orders, inverted files, footrule ranking, exact rerank."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import rows_of
from .session import prepare, shuffle_partitions

PIVOTS, PREFIX = 256, 32
POOL = 8  # distinct vectors looked at for each pivot
BOUNDS = 32  # a query's nearest pivots whose distances bound those of rows that aren't reranked
SHARE, LEAST = 0.15, 100  # of a block's rows, by footrule, those that are reranked; and how many at least
BLOCK = 16_384


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0)


def pivot_orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first."""
    near = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.argsort(near, axis=1, kind="stable")[:, :prefix]


def spread(pool: np.ndarray, n: int) -> np.ndarray:
    """At most n of the pool's vectors, each the farthest from those before it, no two equal."""
    chosen = [0]
    gap = ((pool - pool[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    return pool[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to every pivot, and by how much rounding can have moved any of a vector's."""
    x, p = (vectors**2).sum(1), (pivots**2).sum(1)
    return np.sqrt(np.maximum(x[:, None] + p[None] - 2 * vectors @ pivots.T, 0)), 1e-6 * (np.sqrt(x) + np.sqrt(p.max()))


def distances(by_axis: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances of vectors given axis by axis; squares are added in the order of the axes."""
    total = np.zeros(by_axis.shape[1])
    for axis, x in zip(by_axis, vector):
        total += (axis - x) ** 2
    return np.sqrt(total)


class Postings:
    """Inverted files of a block: for each pivot, the rows that have it in their prefix, and at which rank."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        self.size, self.prefix = orders.shape
        flat = orders.reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.rows, self.ranks = order // self.prefix, (order % self.prefix).astype(np.int32)
        self.bounds = np.searchsorted(flat[order], np.arange(n_pivots + 1))

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """prefix * (prefix + 1) less twice this is the footrule distance, absent pivots standing at rank prefix."""
        total = np.zeros(self.size, np.int64)
        for rank, pivot in enumerate(order.tolist()):
            a, b = self.bounds[pivot], self.bounds[pivot + 1]
            total[self.rows[a:b]] += self.prefix - np.maximum(self.ranks[a:b], rank)
        return total


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query row, by Euclidean distance, ties to the smaller id.

    Pivots are drawn farthest-first from the ``POOL * n_pivots`` distinct vectors with the least hash, so that copies
    and near copies, however many, take the place of few; every row is indexed. Rows whose
    vector is null, empty, zero or holds a null or non-finite component, and rows without an id, take no part.
    Vectors of several dimensions are searched each among those of its own, one index a dimension; rows that repeat a
    query id ask once a dimension (the vector that sorts first). Of rows with one same vector only the k + 1 of least id can be among a query's k nearest, so the
    index holds those (found by a limited window, without gathering the rest). Fewer candidates than k give fewer rows.

    Plan: index rows fall into blocks of about ``block`` by hash of id; the packed queries visit every block; there,
    postings of the query's pivots give footrule distances, and the nearest ``share`` of the block is reranked by exact
    distance. Of the other rows those are measured, too, that the triangle inequality over the query's nearest pivots
    doesn't put beyond the kth distance found, so none is missed; the block's best k go on. Work is spread over blocks
    whatever the data; nothing is broadcast but the pivots.
    """
    spark = prepare(vectors.sparkSession)
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    found = [nearest_of_one_dimension(own.where(F.size("v") == r.d), r.n, k, n_pivots, prefix, share, block) for r in sizes]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"))


def nearest_of_one_dimension(own: DataFrame, n_rows: int, k: int, n_pivots: int, prefix: int, share: float, block: int) -> DataFrame:
    """nearest for rows (id, v, q) whose vectors have one dimension."""
    spark = own.sparkSession
    rows = own.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(POOL * n_pivots).collect()
    pivots = spread(np.array([r.v for r in rows]), n_pivots)
    prefix = min(prefix, len(pivots))
    n_blocks = max(1, -(-n_rows // block))
    indexed = own.select("id", "v").distinct().withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1).drop("copy")
    queries = own.where("q").groupBy("id").agg(F.min("v").alias("v"))

    def pack(part: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as w:
                        w.write_batch(batch)
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        return run

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
            b = pa.ipc.open_stream(payload).read_next_batch()
            return b.column("id").to_numpy(), b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)

        now, held, index = None, [], None
        for number, shard, payload in rows_of(batches):
            if number != now:
                now, held, index = number, [], None
            if shard == 0:
                held.append(unpack(payload))
                continue
            if not held:
                continue
            if index is None:
                ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                by_axis = np.ascontiguousarray(x.T)
                index = Postings(pivot_orders(x, pivots, prefix), len(pivots))
                away, slack = pivot_distances(x, pivots)
                away, squares = np.ascontiguousarray(away.T), (x * x).sum(1)
            most = min(len(ids), max(LEAST, int(np.ceil(share * len(ids)))))
            asked, y = unpack(payload)
            out = []
            for query, vector, own_order, own_away, own_slack in zip(asked.tolist(), y, pivot_orders(y, pivots, prefix), *pivot_distances(y, pivots)):
                own_square = float(vector @ vector)
                error = 1e-12 * (float(squares.max()) + own_square)  # more than rounding moves a square found by a product

                def measured(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    """Those of which that may be among the k nearest, and their exact distances."""
                    which = which[ids[which] != query]
                    rough = squares[which] + own_square - 2 * (x[which] @ vector)
                    if len(which) > k:
                        which = which[rough <= np.partition(rough, k - 1)[k - 1] + 2 * error]
                    return which, distances(by_axis[:, which], vector)

                close = index.closeness(own_order)
                near, score = measured(np.argpartition(-close, most - 1)[:most])
                if len(near) >= k:
                    bound = np.abs(away[own_order[:BOUNDS]] - own_away[own_order[:BOUNDS], None]).max(0)
                    rest = bound <= np.partition(score, k - 1)[k - 1] + slack + own_slack
                else:
                    rest = np.ones(len(ids), bool)
                rest[near] = True
                near, score = measured(np.flatnonzero(rest))
                best = np.lexsort((ids[near], score))[:k]
                out.append((np.full(len(best), query), ids[near[best]], score[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    placed = indexed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("long"))
    # one packed row a block and Arrow batch: rows of a block lie together after the shuffle
    def pack_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else []
            for a, b in zip(cuts, [*cuts[1:], len(numbers)]):
                for packed in pack(0)([batch.select(["id", "v"]).slice(int(a), int(b - a))]):
                    yield pa.RecordBatch.from_arrays([pa.array([int(numbers[a])]), *packed.columns], names=["block", "shard", "payload"])

    n = min(n_blocks, shuffle_partitions(spark))
    left = placed.repartition(max(n, 1), "block").sortWithinPartitions("block").mapInArrow(pack_blocks, "block long, shard int, payload binary")
    asked = queries.repartition(max(1, min(n, 64))).mapInArrow(pack(1), "shard int, payload binary")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "shard", "payload")
    found = left.unionByName(right).repartition(max(n, 1), "block").sortWithinPartitions("block", "shard").mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
