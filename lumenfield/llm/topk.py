"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse: terms with integral weights. The index is a table of blocks of rows, a block's postings lying by term. A query goes through its
own terms; each scatters its weight times the postings' into a dense array of the block's scores, so every row gets its exact inner
product, those without a common term zero. A partition of the array selects the block's k best, and the blocks' are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import input_bytes, stored

#: Rows of an index block, and bytes of postings or queries that a task gets of either side.
BLOCK_ROWS, SIDE_BYTES = 8_192, 64 << 20
LONG, MOST = np.iinfo(np.int64), float(np.finfo(np.float64).max)


def sparse_rows(vectors: DataFrame, scale: float = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, terms, weights) of dense vectors: terms are the positions, weights floor(scale * x) as integral doubles, zeros left out.

    Rows whose key or vector is null, or that have a null or non-finite component, take no part; an empty vector has no terms.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # rounding down in doubles: floor() gives a long, which may overflow, and larger doubles are integral; a product over the largest double is that one
    down = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, F.lit(MOST)), F.lit(-MOST)))
    scaled = vectors.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: down(x.cast("double") * scale)).alias("w"), F.col(vector).isNotNull().alias("there"), bad.alias("bad"))
    scaled = scaled.where("key IS NOT NULL AND there AND NOT bad")
    pairs = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("t"), x.alias("w"))), lambda s: s["w"] != 0)
    return scaled.select("key", pairs.alias("p")).select("key", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))


def build_index(rows: DataFrame) -> DataFrame:
    """The stored index of numbered sparse rows (row, key, terms, weights; a term at most once in a row): (block, rows, keys, terms, at_ends, at, ends, weights).

    A block has BLOCK_ROWS rows or so. Its distinct terms lie in order; a term's postings are a slice of ``at`` (places in the block), closed
    by ``at_ends``, and one of ``weights``, closed by ``ends``. A term that over half of the block's rows have keeps a weight for each row, and no places.
    """
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))

    def build(t: pa.Table) -> pa.Table:
        n = t.num_rows
        lists = t["terms"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        term, weight, row = lists.flatten().to_numpy(), t["weights"].combine_chunks().flatten().to_numpy(), np.repeat(np.arange(n, dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        term, weight, row = term[order], weight[order], row[order]
        names, begins = np.unique(term, return_index=True)
        at, weights = [np.zeros(0, np.int32)], [np.zeros(0)]
        for lo, hi in zip(begins, [*begins[1:], len(term)]):
            if 2 * (hi - lo) > n:
                dense = np.zeros(n)
                dense[row[lo:hi]] = weight[lo:hi]
                weights.append(dense)
                at.append(at[0])
            else:
                weights.append(weight[lo:hi])
                at.append(row[lo:hi])
        one = lambda v, kind: pa.array([v], pa.list_(kind))
        ends = lambda parts: one(np.cumsum([len(p) for p in parts[1:]], dtype=np.int64), pa.int64())
        return pa.table({
            "block": t["block"][:1], "rows": one(t["row"].to_numpy(), pa.int64()), "keys": one(t["key"].to_numpy(), pa.int64()), "terms": one(names, pa.int64()),
            "at_ends": ends(at), "at": one(np.concatenate(at), pa.int32()), "ends": ends(weights), "weights": one(np.concatenate(weights), pa.float64()),
        })

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "row", "key", F.col("terms").cast("array<long>").alias("terms"), "weights")
    return stored(dealt.groupBy("block").applyInArrow(build, "block long, rows array<long>, keys array<long>, terms array<long>, at_ends array<long>, at array<int>, ends array<long>, weights array<double>"), "postings")


class Block:
    """An index block, for scoring."""

    def __init__(self, index: pa.Table, i: int) -> None:
        of = {c: index[c][i].values.to_numpy(zero_copy_only=False) for c in index.column_names[2:]}
        self.rows, self.keys, self.place = of["rows"], of["keys"], {t: j for j, t in enumerate(of["terms"].tolist())}
        self.at, self.plain = np.split(of["at"], of["at_ends"][:-1]), of["weights"]
        self.most = float(np.abs(self.plain).max()) if len(self.plain) else 0.0
        self.safe = self.most < 2.0**62
        self.weights = np.split(self.plain.astype(np.int64) if self.safe else self.plain, of["ends"][:-1])

    def scores(self, terms: list[int], weights: list[float]) -> np.ndarray:
        """The exact inner products with all rows; beyond the ends of a long, that end. Python's integers where a sum could overflow."""
        safe = self.safe and sum(map(abs, weights)) * self.most < 2.0**62
        out = np.zeros(len(self.rows), np.int64 if safe else object)
        for t, w in zip(terms, weights):
            if (i := self.place.get(t)) is None:
                continue
            add = self.weights[i] * int(w) if safe else np.array([int(x) * int(w) for x in self.weights[i].tolist()], object)
            if len(self.at[i]):
                out[self.at[i]] += add
            else:
                out += add
        return out if safe else np.array([min(max(int(s), LONG.min), LONG.max) for s in out], np.int64)

    def best(self, row: int, terms: list[int], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, key) of the k best rows other than ``row``: largest score first, ties to the smaller key."""
        score, keys = self.scores(terms, weights), self.keys
        if (own := np.flatnonzero(self.rows == row)).size:
            score, keys = np.delete(score, own), np.delete(keys, own)
        if len(score) > k:
            floor = np.partition(score, len(score) - k)[len(score) - k]
            over = np.flatnonzero(score > floor)
            level = np.flatnonzero(score == floor)  # of the last ones, equal scores go to the smallest keys
            if len(level) > k - len(over):
                level = level[np.argpartition(keys[level], k - len(over) - 1)[: k - len(over)]]
            at = np.concatenate([over, level])
            score, keys = score[at], keys[at]
        order = np.lexsort((keys, -score.astype(object))) if len(score) and score.min() == LONG.min else np.lexsort((keys, -score))
        return score[order], keys[order]


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, key, score: for each of the sparse rows (key, terms, weights) that is_query holds for, the k rows of largest
    inner product, ties to the smaller key, among all rows but itself; all of them, if there are fewer.

    Repeated keys are rows of their own. Weights are integral doubles; scores are exact. Empty tables give no rows, rows without terms score 0.
    Rows are numbered and written first, so a row is known again whatever is lost. The plane of blocks and queries is cut into
    stripes of blocks and groups of queries of at most about SIDE_BYTES; a task gets one pair of these, the query set making so many necessary.
    """
    spark = rows.sparkSession
    rows = stored(rows.select("key", "terms", "weights", F.coalesce(is_query, F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("row")), "rows")
    queries = rows.where("query").select("row", "key", F.col("terms").cast("array<long>").alias("terms"), "weights")
    index = build_index(rows)
    blocks, n_queries, n_rows = index.count(), queries.count(), rows.count()
    size = 4 * input_bytes(rows) / max(n_rows, 1)  # Parquet packs small weights to a quarter or less
    stripes = max(1, min(blocks, math.ceil(n_rows * size / SIDE_BYTES)))
    groups = max(1, math.ceil(n_queries * size / SIDE_BYTES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if stripes * groups < tasks:
        stripes = min(blocks, max(stripes, math.ceil(tasks / groups))) or 1
        groups = max(groups, math.ceil(tasks / stripes))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.select((F.col("block") % stripes).alias("s"), every(groups).alias("g"), "rows", "keys", "terms", "at_ends", "at", "ends", "weights")
    right = queries.select(every(stripes).alias("qs"), F.pmod(F.xxhash64("row"), F.lit(groups)).alias("qg"), "row", "key", "terms", "weights")

    def accumulate(index: pa.Table, queries: pa.Table) -> pa.Table:
        of: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held = [Block(index, i) for i in range(index.num_rows)]
        for i, (row, terms, weights) in enumerate(zip(queries["row"].to_pylist(), queries["terms"].to_pylist(), queries["weights"].to_pylist())):
            found = [b.best(row, terms, weights, k) for b in held]
            if not found:
                continue
            score, key = (np.concatenate(x) for x in zip(*found))
            at = sorted(range(len(score)), key=lambda j: (-int(score[j]), int(key[j])))[:k]
            of.append(np.full(len(at), i))
            scores.append(score[at])
            keys.append(key[at])
        at = np.concatenate(of) if of else np.zeros(0, np.int64)
        whole = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"row": queries["row"].take(pa.array(at)), "query_id": queries["key"].take(pa.array(at)), "key": whole(keys), "score": whole(scores)})

    partial = left.groupBy("s", "g").cogroup(right.groupBy("qs", "qg")).applyInArrow(accumulate, "row long, query_id long, key long, score long")
    # the merge: at most k rows of each stripe, the least kept by rank
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "key"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")

