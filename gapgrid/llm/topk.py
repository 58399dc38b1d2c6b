"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds on what is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.llm.common import discard, map_batches, materialize, ship

BLOCK = 2048
BLOCKS = 1 << 16
QUERY_BLOCK = 1024
GROUP = 7
HEAD = 16
EXACT = float(1 << 53)
NONE = -(1 << 63)


def integer_vectors(df: DataFrame, key: str, vector: str, flag: str, scale: int = 64) -> DataFrame:
    """(``id``, ``v``: floor(scale * x) of each component x as long, ``query``: the value of ``flag``).

    Vectors that are null or hold null or non-finite components, and rows with a null key, take no part.
    """
    x = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return df.where(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.col(flag).alias("query"))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the whole table, from sums of products: dim x dim numbers reach the driver."""
    def grams(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column(0), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(total.ravel())], ["i", "j", "x"])

    rows = map_batches(vectors.select("v"), grams, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((dim, dim))
    for r in rows:
        gram[r.i, r.j] = r.x
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64)


class Block:
    """Vectors of a block by descending norm: whole numbers as doubles, rotated heads, and the norms of the rotated tails."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, head: int):
        x = v.astype(np.float64)
        norm = np.sqrt((x ** 2).sum(1))
        self.order = np.lexsort((ids, -norm))
        self.ids, self.norm = ids[self.order], norm[self.order]
        self.v = (x if v.dtype == np.float64 or norm.max(initial=0) ** 2 < EXACT else v)[self.order]
        rotated = x[self.order] @ turn
        self.head, self.tail = rotated[:, :head], np.sqrt((rotated[:, head:] ** 2).sum(1))


def products(q: Block, c: Block, rows: np.ndarray, cols: slice) -> np.ndarray:
    """Exact inner products: doubles below 2^53, else 64-bit whole numbers."""
    a, b = q.v[rows], c.v[cols]
    if a.dtype == b.dtype == np.float64 and q.norm[0] * c.norm[0] < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _wide(x, scale):
    """Bounds are widened by more than the rounding of the rotation."""
    return x + 1e-9 * scale + 1e-6


def search(q: Block, c: Block, k: int, floor: np.ndarray, floor_id: np.ndarray, step: int = 512):
    """(query row, candidate row, score) of the ``k`` best candidates of each query that come before its floor.

    A floor is a score and an id: a candidate counts if its score is larger, or equal with a smaller id. Floors rise as candidates
    are scored. A step of candidates is scored by one matrix product for the queries that one of its bounds lets in.
    """
    floor, floor_id = floor.copy(), floor_id.copy()
    row, col, score = (np.empty(0, np.int64) for _ in range(3))
    for i in range(0, len(c.ids), step):
        top = c.norm[i] * q.norm
        live = np.flatnonzero(_wide(top, top) >= floor)  # norms only fall from here on
        if not len(live):
            break
        s = slice(i, i + step)
        bound = q.head[live] @ c.head[s].T
        bound += q.tail[live][:, None] * c.tail[s]
        may = bound.max(1) >= floor[live] - 1e-9 * top[live] - 1e-6
        live = live[may]
        if not len(live):
            continue
        x = products(q, c, live, s)
        x[q.ids[live][:, None] == c.ids[s]] = NONE
        least = floor[live]
        if x.shape[1] > k:  # a step gives k scores and what ties with the last of them
            least = np.maximum(least, np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k])
        a, b = np.nonzero((x >= least[:, None]) & (x > NONE))
        r, y = live[a], x[a, b]
        b = b + i
        ok = (y > floor[r]) | (c.ids[b] < floor_id[r])
        if not ok.any():
            continue
        row, col, score = (np.concatenate(z) for z in ((row, r[ok]), (col, b[ok]), (score, y[ok])))
        order = np.lexsort((c.ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == k - 1
        floor[row[last]], floor_id[row[last]] = score[last], c.ids[col[last]]
        few = rank < k
        row, col, score = row[few], col[few], score[few]
    return row, col, score


def norms(x: np.ndarray, turn: np.ndarray, head: int) -> list[np.ndarray]:
    """Lengths of the vectors, of their rotated heads and of the tails."""
    r = x @ turn
    return [np.sqrt((y ** 2).sum(1)) for y in (x, r[:, :head], r[:, head:])]


def _bounds(blocks: DataFrame, turn: np.ndarray, dim: int, head: int) -> DataFrame:
    """(cb, norm, head, tail): the largest norms of a block's vectors, of their rotated heads and of the tails."""
    def run(batches):
        for batch in batches:
            parts = norms(matrix(batch.column(1), dim).astype(np.float64), turn, head)
            cb = batch.column(0).to_numpy()
            for b in np.unique(cb):
                yield pa.RecordBatch.from_arrays([pa.array([b])] + [pa.array([p[cb == b].max()]) for p in parts], ["cb", "norm", "head", "tail"])

    rows = map_batches(blocks.select("cb", "v"), run, "cb long, norm double, head double, tail double")
    return rows.groupBy("cb").agg(F.max("norm").alias("norm"), F.max("head").alias("head"), F.max("tail").alias("tail"))


def top_k(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the ``k`` largest whole-number inner products of every query row with all other ids.

    Ties go to the smaller id; fewer than ``k`` candidates give them all; rows of the query's own id are no candidates;
    repeated candidate rows count each, a repeated query id is answered once (by its least vector). Vectors of different
    lengths are an error, and so are vectors whose squared norm reaches 2^62, as scores would leave 64 bits; empty tables
    give an empty result; other columns are ignored.

    Candidates stand in blocks by falling norm, ``BLOCKS`` at most, each with its largest norms (whole, rotated head, tail). The
    first block gives each query a floor; further blocks are taken in groups of growing size. Before a group is shuffled, a query
    is paired with those of its blocks whose Cauchy-Schwarz bound reaches the query's floor, and only the blocks and queries
    paired are sent to each other; what is found raises the floors of the next group.
    """
    spark = df.sparkSession
    ship(spark)
    flag = "is_query"
    while flag in df.columns:
        flag += "_"
    src = df.withColumn(flag, F.coalesce(is_query, F.lit(False)))
    vec = integer_vectors(src, key, vector, flag)
    vec = materialize(vec.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), "vectors")
    dims = vec.agg(F.min(F.size("v")), F.max(F.size("v")), F.count("*"), F.max("norm2")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not dims[2]:
        return spark.createDataFrame([], schema)
    if dims[0] != dims[1]:
        raise ValueError(f"vectors of {dims[0]} to {dims[1]} components")
    if dims[3] >= float(1 << 62):
        raise ValueError("inner products would leave 64 bits")
    dim, head = dims[0], min(HEAD, dims[0])
    turn = rotation(vec, dim) if dim else np.zeros((0, 0))
    size = max(BLOCK, -(-dims[2] // BLOCKS))
    blocks = vec.repartitionByRange(-(-dims[2] // size), F.desc("norm2"), "id").select("id", "v", F.spark_partition_id().cast("long").alias("cb"))
    blocks = materialize(blocks, "blocks")
    bounds = np.array([tuple(r) for r in _bounds(blocks, turn, dim, head).orderBy("cb").collect()])  # a row of four numbers per block, BLOCKS at most
    last = int(bounds[-1, 0])
    queries = vec.where("query").groupBy("id").agg(F.min("v").alias("v"))
    n_qb = max(1, -(-queries.count() // QUERY_BLOCK))

    queries = materialize(queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_qb))), "query-vectors")

    def blocks_of(some):
        """Pairs each query with the blocks of ``some`` whose bound reaches its floor."""
        cb = pa.array(some[:, 0].astype(np.int64))

        def run(batches):
            for batch in batches:
                for i in range(0, len(batch), 64):
                    part = batch.slice(i, 64)
                    norm, first, tail = norms(matrix(part.column(1), dim).astype(np.float64), turn, head)
                    bound = np.minimum(np.outer(norm, some[:, 1]), np.outer(first, some[:, 2]) + np.outer(tail, some[:, 3]))
                    row, col = np.nonzero(_wide(bound, np.outer(norm, some[:, 1])) >= part.column(3).to_numpy()[:, None])
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(row)) for c in part.columns] + [cb.take(pa.array(col))], ["id", "v", "qb", "floor", "floor_id", "cb"])
        return run

    def compare(_, left, right):
        q = Block(left["id"].to_numpy(), matrix(left["v"].combine_chunks(), dim), turn, head)
        c = Block(right["id"].to_numpy(), matrix(right["v"].combine_chunks(), dim), turn, head)
        if not len(q.ids) or not len(c.ids):
            row = col = score = np.empty(0, np.int64)
        else:
            row, col, score = search(q, c, k, left["floor"].to_numpy()[q.order], left["floor_id"].to_numpy()[q.order])
        return pa.table([q.ids[row], c.ids[col], score], ["query_id", "vec_id", "score"])

    def best_of(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    found, first, end = None, 0, 0
    while first <= last:
        q = queries
        if found is None:
            q = q.withColumn("floor", F.lit(NONE)).withColumn("floor_id", F.lit(NONE))
        else:
            floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
            q = q.join(floors, "id", "left").fillna(NONE, ["floor", "floor_id"])
        some = bounds[(bounds[:, 0] >= first) & (bounds[:, 0] <= end)]
        q = map_batches(q.select("id", "v", "qb", "floor", "floor_id"), blocks_of(some), "id long, v array<long>, qb long, floor long, floor_id long, cb long")
        q = materialize(q, f"queries-{first}")
        c = blocks.where(F.col("cb").between(first, end)).join(q.select(F.col("qb").alias("to"), "cb").distinct(), "cb").select("id", "v", "to", "cb")
        more = q.groupBy("qb", "cb").cogroup(c.groupBy("to", "cb")).applyInArrow(compare, "query_id long, vec_id long, score long")
        if found is not None:
            more = more.unionByName(found.drop("rank"))
        old, found = found, materialize(best_of(more), f"best-{first}")
        discard(q, *([] if old is None else [old]))
        first, end = end + 1, min(last, end + GROUP * (end + 1))
    discard(blocks, vec, queries)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
