"""Nearest neighbours by inner product: a block matrix join over int8 tiles.

Vectors are quantised to int8 with a scale of their own. A tile is the product of a block of queries and a block of
candidates; its int8 inner products, times both scales, miss the true ones by a bound that follows from the rounding
errors. In a tile a pair survives if its upper bound reaches the K-th largest lower bound of its query; survivors are
recomputed from the original vectors in double precision and go to a heap of K for each query. The heaps of a query's
tiles are merged at the end. No pair is lost: a pair that is dropped is beaten by K others of its own tile.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_bytes

#: Rows of a block. A tile holds QUERY_ROWS x CANDIDATE_ROWS floats.
QUERY_ROWS, CANDIDATE_ROWS = 512, 4096
#: Bytes of vectors that a task gets of either side, and of heaps that it merges.
SIDE_BYTES = 32 << 20


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, every component there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values as float32, scale, Euclidean length of the rounding error) of each row."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # denormals
    q = np.clip(np.rint(v / scale[:, None]), -127, 127)
    return q.astype(np.float32), scale, np.linalg.norm(v - q * scale[:, None], axis=1)


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query the k best of the candidates, (-score, id), best first, ties to the smaller id; ids equal to the
    query's take no part."""
    a, sa, ea = quantised(q)
    b, sb, eb = quantised(c)
    near = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):  # sums of up to 1,040 int8 products are exact in float32
        near += a[:, i : i + 1024] @ b[:, i : i + 1024].T
    near *= sa[:, None] * sb[None, :]
    nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|, and |q'| <= |q| + |q - q'|; the last term is for rounding itself
    miss = ea[:, None] * nc[None, :] + (nq + ea)[:, None] * eb[None, :] + 1e-6 * nq[:, None] * nc[None, :]
    near[qid[:, None] == cid[None, :]] = -np.inf
    low = near - miss
    live = min(k, low.shape[1])
    floor = np.partition(low, low.shape[1] - live, axis=1)[:, low.shape[1] - live]
    up, out = near + miss, []
    for i in range(len(qid)):
        at = np.flatnonzero((up[i] >= floor[i]) & (near[i] > -np.inf))
        score = np.cumsum(c[at] * q[i], axis=1)[:, -1] if len(at) else np.zeros(0)  # one order of adding, on any machine
        out.append(heapq.nsmallest(k, zip((-score).tolist(), cid[at].tolist())))
    return out


def cuts(rows: int, queries: int, size: float, tasks: int) -> tuple[int, int]:
    """Stripes of candidates and groups of queries, of vectors of ``size`` bytes each.

    Every candidate is sent to all groups and every query to all stripes, so as few of either as memory allows are best:
    SIDE_BYTES of vectors each. Where that makes fewer than ``tasks`` pairs of them, both are raised to it in the ratio
    that moves the least.
    """
    stripes, groups = max(1, math.ceil(rows * size / SIDE_BYTES)), max(1, math.ceil(queries * size / SIDE_BYTES))
    if stripes * groups < tasks:
        groups = max(groups, round(math.sqrt(tasks * queries / max(rows, 1))))
        stripes = max(stripes, math.ceil(tasks / groups))
    return stripes, groups


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, score: the k nearest of every row that is_query holds for, among all rows with another key.

    Rows whose key is null or whose vector isn't usable() take no part; vectors of different lengths are not compared;
    of rows that share a key the smallest vector counts; queries without candidates, and empty tables, give no rows.
    The plane of pairs is cut into stripes of candidates and groups of queries; a task gets the pairs of one stripe and
    one group, in blocks. The query set makes so many pairs necessary. See cuts() for how many of each there are; neither side is ever
    held whole by a task or the driver.
    """
    spark = vectors.sparkSession
    n = vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(is_query, F.lit(False))).alias("queries")).first()
    size = input_bytes(vectors) / max(n.rows, 1) if input_bytes(vectors) < 1 << 60 else 1024
    stripes, groups = cuts(n.rows, n.queries, size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = rows.withColumns({"dim": F.size("v"), "s": F.pmod(F.xxhash64("id"), F.lit(stripes)), "g": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups))})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = rows.select("s", every(groups).alias("g"), "dim", "id", "v")
    queries = rows.where("q").select(every(stripes).alias("qs"), F.col("g").alias("qg"), F.col("dim").alias("qdim"), F.col("id").alias("qid"), F.col("v").alias("qv"))

    def matrix(t: pa.Table, ids: str, vs: str) -> tuple[np.ndarray, np.ndarray]:
        values = t[vs].combine_chunks()
        return t[ids].to_numpy(), np.asarray(values.flatten(), np.float64).reshape(t.num_rows, -1)

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        best: list[tuple[int, list[tuple[float, int]]]] = []
        if left.num_rows and right.num_rows:
            (cid, c), (qid, q) = matrix(left, "id", "v"), matrix(right, "qid", "qv")
            for i in range(0, len(qid), QUERY_ROWS):
                heaps: list[list[tuple[float, int]]] = [[] for _ in qid[i : i + QUERY_ROWS]]
                for j in range(0, len(cid), CANDIDATE_ROWS):
                    found = tile(qid[i : i + QUERY_ROWS], q[i : i + QUERY_ROWS], cid[j : j + CANDIDATE_ROWS], c[j : j + CANDIDATE_ROWS], k)
                    heaps = [heapq.nsmallest(k, heapq.merge(h, f)) for h, f in zip(heaps, found)]
                best += [(int(x), h) for x, h in zip(qid[i : i + QUERY_ROWS], heaps) if h]
        return pa.table(
            {"query_id": pa.array([x for x, _ in best], pa.int64()), "ids": pa.array([[v for _, v in h] for _, h in best], pa.list_(pa.int64())), "scores": pa.array([[-s for s, _ in h] for _, h in best], pa.list_(pa.float64()))}
        )

    def merged(t: pa.Table) -> pa.Table:
        by: dict[int, list[list[tuple[float, int]]]] = {}
        for i, v, s in zip(*(t[c].to_pylist() for c in ("query_id", "ids", "scores"))):
            by.setdefault(i, []).append([(-x, y) for x, y in zip(s, v)])
        best = [(i, r, -s, v) for i, h in by.items() for r, (s, v) in enumerate(heapq.nsmallest(k, heapq.merge(*h)), 1)]
        return pa.table({"query_id": pa.array([x[0] for x in best], pa.int64()), "rank": pa.array([x[1] for x in best], pa.int32()), key: pa.array([x[3] for x in best], pa.int64()), "score": pa.array([x[2] for x in best], pa.float64())})

    heaps = candidates.groupBy("s", "g", "dim").cogroup(queries.groupBy("qs", "qg", "qdim")).applyInArrow(product, "query_id long, ids array<long>, scores array<double>")
    merges = max(1, math.ceil(n.queries * stripes * k * 64 / SIDE_BYTES))  # queries whose heaps one task merges are a merge
    return heaps.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(merges)).alias("merge")).applyInArrow(merged, f"query_id long, rank int, {key} long, score double")
