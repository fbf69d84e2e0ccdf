"""Operator 1: nearest neighbours by inner product as a block matrix join.

Vectors are packed into blocks, every query block meets every candidate block
of the same length (a *tile*), and a tile is computed in two steps:

1. the int8 codes of both blocks are multiplied (one exact integer matrix
   product). With ``x = s * code + e`` Cauchy-Schwarz gives
   ``|q.c - sq*sc*codes| <= |q||ec| + |eq||s*code_c|``, so every pair has a
   lower and an upper bound;
2. only pairs whose upper bound reaches the query's k-th best so far (its
   heap, or the k-th best lower bound of the tile) are recomputed in double
   precision and pushed to the query's bounded heap.

No true neighbour is lost: pruning uses proven bounds only. Heaps are carried
over the tiles of a slice of candidate blocks; a window merges the slices.

Rules: vectors null, empty, all zero, or holding a null or non-finite component
take no part; null ids neither. Rows that repeat id and vector count once; the
different vectors of one query id are one query with the best of all. A query never
returns its own id. Vectors of different length never meet. Ties
go to the smaller id. Fewer than k candidates: all of them. Empty table: no rows."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upshelf.llm.common import small_batches, written


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (v.where("id is not null and v is not null and size(v) > 0").where(~bad)
            .where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")))


def _blocks(v: DataFrame, n: int, tag: str) -> DataFrame:
    """One row per block: ids and vectors of the rows that hash to it."""
    return (v.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(tag))
            .agg(F.collect_set(F.struct("id", "v")).alias("rows")))


class _Block:
    def __init__(self, rows: pa.Array, dim: int):
        flat = rows.flatten()
        self.ids = np.asarray(flat[0] if isinstance(flat, list) else flat.field("id"), dtype=np.int64)
        vec = flat[1] if isinstance(flat, list) else flat.field("v")
        x = np.asarray(vec.flatten(), dtype=np.float64).reshape(len(self.ids), dim)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.x = self.ids[order], np.ascontiguousarray(x[order])
        top = np.abs(self.x).max(axis=1)
        s = top / 127.0
        s[s == 0] = np.finfo(np.float64).tiny          # subnormal vectors: codes stay within int8
        code = np.clip(np.rint(self.x / s[:, None]), -127, 127)
        back = code * s[:, None]
        norm = lambda a: np.sqrt((a * a).sum(axis=1))
        self.s, self.err, self.coded, self.norm = s, norm(self.x - back), norm(back), norm(self.x)
        self.code = code.astype(np.int8)

    def wide(self, dim: int):
        # products of int8 codes are whole numbers: exact in float32 while dim * 127^2 < 2^24
        return self.code.astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)


def _tile(q: _Block, c: _Block, dim: int, k: int, heaps: list) -> int:
    approx = (q.wide(dim) @ c.wide(dim).T).astype(np.float64)
    approx *= q.s[:, None]
    approx *= c.s[None, :]
    err = q.norm[:, None] * c.err[None, :] + q.err[:, None] * c.coded[None, :]
    err += 1e-12 * (q.norm[:, None] * c.norm[None, :])  # rounding of the bounds themselves
    own = q.ids[:, None] == c.ids[None, :]
    low = np.where(own, -np.inf, approx - err)
    low[np.isnan(low)] = -np.inf                        # beyond the range of doubles nothing is known
    high = approx + err
    floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
    qi, ci = np.nonzero(~(high < floor[:, None]) & ~own)
    for a in range(0, len(qi), 65536):
        i, j = qi[a:a + 65536], ci[a:a + 65536]
        # added up left to right, so equal vectors score equally wherever they stand
        score = np.cumsum(q.x[i] * c.x[j], axis=1)[:, -1]
        for r, s, cid in zip(i.tolist(), score.tolist(), c.ids[j].tolist()):
            h = heaps[r]
            if len(h) < k:
                heapq.heappush(h, (s, -cid))
            elif (s, -cid) > h[0]:
                heapq.heapreplace(h, (s, -cid))
    return len(qi)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            query_block: int = 512, cand_block: int = 4096, blocks_per_slice: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product.

    ``is_query`` is a predicate over ``id``. Block sizes bound memory: a tile
    holds query_block x cand_block doubles a few times over."""
    spark = vectors.sparkSession
    small_batches(spark, 8)
    v = clean(vectors, id_col, vec_col)
    q = v.where(is_query)
    n, nq = v.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("nq")).first()
    ncb, nqb = max(1, math.ceil(n / cand_block)), max(1, math.ceil(nq / query_block))
    slices = max(1, math.ceil(ncb / blocks_per_slice))
    qb = (written(_blocks(q, nqb, "qb"), "ann-q")
          .select("dim", "qb", F.col("rows").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")))
    cb = (written(_blocks(v, ncb, "cb"), "ann-c")
          .select("dim", F.pmod("cb", F.lit(slices)).alias("slice"), F.col("rows").alias("c"),
                  F.explode(F.sequence(F.lit(0), F.lit(nqb - 1))).alias("qb")))
    tiles = (cb.join(qb.hint("merge"), ["dim", "qb", "slice"]).select("dim", "qb", "slice", "q", "c"))

    def run(batches):
        at, block, heaps = None, None, []

        def flush():
            if at is not None:
                tops = [sorted(h, reverse=True) for h in heaps]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(block.ids, pa.int64()),
                    "top": pa.array([[{"score": s, "neg": i} for s, i in t] for t in tops],
                                    pa.list_(pa.struct([("score", pa.float64()), ("neg", pa.int64())])))})

        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                dim, qn, sl = (one.column(i)[0].as_py() for i in range(3))
                if (dim, qn, sl) != at:
                    yield from flush()
                    at, block = (dim, qn, sl), _Block(one.column(3), dim)
                    heaps = [[] for _ in block.ids]
                _tile(block, _Block(one.column(4), dim), dim, k, heaps)
        yield from flush()

    tops = tiles.mapInArrow(run, "query_id long, top array<struct<score double, neg long>>")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("neg")))
    return (tops.select("query_id", F.inline("top")).withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", (-F.col("neg")).alias("vec_id"), "score"))
