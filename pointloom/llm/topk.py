"""Exact top-k by integer inner product, with a pivot table to bound what need not be evaluated.

Rows are integer vectors. The distances of every row to a set of pivots are computed once and written
beside the vector (the index). For a query q and a row x, any pivot p gives |d(q,p) - d(x,p)| <= d(q,x),
and the inner product is (|q|^2 + |x|^2 - d(q,x)^2) / 2: the largest of these lower bounds gives an upper
bound of the score. Rows are evaluated in the order of that bound until the k-th best score found exceeds
every bound left. Nothing is approximate: bounds carry a slack above their rounding error.

Queries go out in blocks of fixed size, one broadcast at a time, each against all rows; a block's findings are written
before the next goes out and its broadcast is freed, so neither plan nor memory grows with their number. The rows are
never shuffled or collected, and only k rows for each query and partition meet in the final ranking.

How much the bounds spare depends on the data: where all distances are alike, as among random directions in many
dimensions, no pivot tells rows apart. ``elimination`` counts what was evaluated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Stage

#: Rows of a query block: the broadcast is QUERY_BLOCK vectors at most, whatever the input's size.
QUERY_BLOCK = 8192
#: Pivots; drawn from the rows by hash, never more than this.
PIVOTS = 64
#: Candidates evaluated at first for a query before the bound is looked at again; GROWTH times as many each further time.
STEP = 64
GROWTH = 4
#: Queries whose bounds are held in memory at once; few, so that they stay in the processor's cache.
QUERY_TILE = 16


def to_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) for each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Vectors that are null or hold null or non-finite components take no part. Empty ones do."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _of_length(lists: list[list[int]], n: int) -> np.ndarray:
    some = [v for v in lists if len(v) == n]
    return np.array(some, dtype=np.float64).reshape(len(some), n)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Vectors of different lengths do not match; each length is worked on by itself."""
    lengths = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n)) if (lengths != n).any() else batch


def _exact(m: np.ndarray) -> np.ndarray:
    """Single or double floats where every inner product is exact in them, else Python integers."""
    most = float(np.abs(m.astype(np.float64)).max()) ** 2 * m.shape[1] if m.size else 0.0
    return m.astype(np.float32 if most < 2**23 else np.float64 if most < 2**52 else object)


def build_index(vectors: DataFrame, stage: Stage, *, id_col: str, vec_col: str, scale: int = 256, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(table of vec_id, v array<long>, d array<double>; pivots): every usable row, with its distances to the pivots."""
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), to_integers(F.col(vec_col), scale).alias("v"))
    chosen = rows.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(pivots).collect()  # at most ``pivots`` rows
    lists = [r["v"] for r in chosen]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in _by_length(whole_batch, 1):
                x = _matrix(b.column(1)).astype(np.float64)
                p = _of_length(lists, x.shape[1])
                gap = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * x @ p.T))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(gap.ravel()), p.shape[0]).cast(pa.list_(pa.float64())) if p.shape[0] else pa.array([[]] * len(b), pa.list_(pa.float64()))], ["vec_id", "v", "d"])

    index = stage.table(rows.mapInArrow(measure, "vec_id bigint, v array<bigint>, d array<double>"), "pivot-table")
    return index, lists


class _Queries:
    """A block of queries of one length, and the best found so far in a partition."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: list[list[int]], k: int):
        self.ids, self.exact, self.k = ids, _exact(vectors), k
        q = vectors.astype(np.float64)
        self.norm = (q * q).sum(1)
        p = _of_length(lists, q.shape[1])
        self.d = np.sqrt(np.maximum(0.0, self.norm[:, None] + (p * p).sum(1)[None, :] - 2.0 * q @ p.T))
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), ascending
        self.evaluated, self.met = [0] * len(ids), 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray, d: np.ndarray) -> None:
        x = _exact(vectors)
        big = x.dtype == object or self.exact.dtype == object
        once = len(np.unique(ids)) == len(ids)
        xf = vectors.astype(np.float64)
        norm = (xf * xf).sum(1)
        self.met += len(ids)
        d = np.ascontiguousarray(d.T)
        for a in range(0, len(self.ids), QUERY_TILE):
            tile = slice(a, min(a + QUERY_TILE, len(self.ids)))
            low = np.zeros((tile.stop - tile.start, len(ids)))
            gap = np.empty_like(low)
            for j in range(len(d)):
                np.abs(np.subtract(self.d[tile, j, None], d[j], out=gap), out=gap)
                np.maximum(low, gap, out=low)
            total = self.norm[tile, None] + norm[None, :]
            # rounding: distances carry about 1e-8 of the norms' root, hence the slack in the square
            low = np.maximum(0.0, low - 1e-6 * (1.0 + np.sqrt(total)))
            bound = np.minimum((total - low * low) / 2, np.sqrt(self.norm[tile, None] * norm[None, :])) + 1e-6 * (1.0 + total)
            for i in range(tile.start, tile.stop):
                self._one(i, ids, x, bound[i - tile.start], big, once)

    def _one(self, i: int, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, big: bool, once: bool) -> None:
        best, k = self.best[i], self.k
        left = np.flatnonzero(bound >= -best[-1][0]) if len(best) == k else np.arange(len(ids))
        q = self.exact[i].astype(object) if big else self.exact[i]
        step = STEP
        while len(left):
            # the rows of highest bound come next
            if len(left) > step:
                cut = np.argpartition(-bound[left], step)
                now, left = left[cut[:step]], left[cut[step:]]
            else:
                now, left = left, left[:0]
            step *= GROWTH
            self.evaluated[i] += len(now)
            score = x[now] @ q
            if not big:
                score = score.astype(np.float64)
            if len(best) == k:
                keep = score >= -best[-1][0]
                now, score = now[keep], score[keep]
            if len(now):
                if len(now) > 4 * k and not big and once:
                    floor_ = np.partition(score, len(score) - k - 1)[len(score) - k - 1]  # one more: the query's own row may be there
                    now, score = now[score >= floor_], score[score >= floor_]
                own = int(self.ids[i])
                best += [(-int(s), int(v)) for s, v in zip(score, ids[now], strict=True) if int(v) != own]
                best.sort()
                if len({v for _, v in best}) < len(best):  # an id counts once, by its best score
                    best[:] = sorted({v: s for s, v in reversed(best)}.items(), key=lambda e: (e[1], e[0]))
                    best[:] = [(s, v) for v, s in best]
                del best[k:]
            if len(best) == k and len(left):
                left = left[bound[left] >= -best[-1][0]]


_FOUND = "query_id bigint, vec_id bigint, score bigint, evaluated bigint, met bigint"


def _found(vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, scale: int, query_block: int, pivots: int) -> DataFrame:
    """A staged table of what every partition found, and one row a query and partition (vec_id null) of what it took."""
    spark = vectors.sparkSession
    ship(spark)
    stage = Stage(spark, "topk")
    index, lists = build_index(vectors, stage, id_col=id_col, vec_col=vec_col, scale=scale, pivots=pivots)
    asked = index.where(is_query).select("vec_id", "v").distinct()
    n = asked.count()
    if not n:
        return spark.createDataFrame([], _FOUND)
    blocks = -(-n // query_block)
    # dealt round robin into ``blocks`` parts of even size and numbered, so each part is read, and sent out, by itself
    at, out = stage.path("queries"), stage.path("found")
    asked.repartition(blocks).withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(at)
    parts = spark.read.parquet(at)
    for block in range(blocks):
        rows = parts.where(F.col("block") == block).select("vec_id", "v").collect()  # about query_block rows
        sent = spark.sparkContext.broadcast([(r["vec_id"], r["v"]) for r in rows])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by_length: dict[int, _Queries] = {}
            for n_ in {len(v) for _, v in sent.value}:
                mine = [(i, v) for i, v in sent.value if len(v) == n_]
                by_length[n_] = _Queries(np.array([i for i, _ in mine]), np.array([v for _, v in mine], dtype=np.int64).reshape(len(mine), n_), lists, k)
            for whole_batch in batches:
                for b in _by_length(whole_batch, 1):
                    x = _matrix(b.column(1))
                    if x.shape[1] in by_length:
                        by_length[x.shape[1]].meet(b.column(0).to_numpy(), x, _matrix(b.column(2)))
            rows = [(int(q.ids[i]), v, -s, None, None) for q in by_length.values() for i, best in enumerate(q.best) for s, v in best]
            rows += [(int(q.ids[i]), None, None, q.evaluated[i], q.met) for q in by_length.values() for i in range(len(q.ids))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)], [f.split()[0] for f in _FOUND.split(", ")])

        index.mapInArrow(search, _FOUND).write.mode("append").parquet(out)
        sent.destroy()
    return spark.read.schema(_FOUND).parquet(out)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """The k highest integer inner products of each query row: query_id, rank, vec_id, score.

    is_query: a condition on ``vec_id``, the name that the index gives the id. Candidates are all usable rows with another id; ties go to the smaller
    id; fewer than k candidates give fewer rows. Rows without an id take no part. A query id that occurs in several rows is asked once for each
    different vector and its answers are merged; repeated candidate rows with one id count once (their best score).
    Empty tables give no rows. Vectors of another length than the query's do not match it; empty vectors match one
    another, with score 0. Other columns are ignored, whatever their names.
    """
    found = _found(vectors, is_query, k, id_col, vec_col, scale, query_block, pivots).where("vec_id IS NOT NULL")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return merged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def elimination(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """What a search took: (query_id, evaluated, met): inner products computed, of all rows of the query's length."""
    found = _found(vectors, is_query, k, id_col, vec_col, scale, query_block, pivots).where("vec_id IS NULL")
    return found.groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"), F.sum("met").alias("met"))


TOP_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(CASE WHEN len(q.v) = 0 THEN 0 ELSE list_inner_product(q.v, c.v) END AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
