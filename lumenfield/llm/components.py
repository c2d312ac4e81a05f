"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A key of more rows than this, and than this share of all rows, is answered by broadcast.
OFTEN, SHARE = 1_000, 1e-4


def with_least(df: DataFrame, by: str, value: str, out: str, rows: int) -> DataFrame:
    """df with the least ``value`` among its rows of equal ``by`` (not null). rows: how many df has, or more.

    Minima are partly made before they move. The rows of a frequent key don't move at all: a key is frequent if it has over
    SHARE of the rows, so there are at most 1 / SHARE of them, and their minima are broadcast. The rest meet by key.
    """
    least = df.groupBy(by).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("_rows"))
    limit = max(OFTEN, int(rows * SHARE))
    often = F.broadcast(least.where(F.col("_rows") > limit).drop("_rows"))
    rest = df.join(often.select(by), by, "left_anti").join(least.where(F.col("_rows") <= limit).drop("_rows"), by)
    return df.join(often, by).select(*df.columns, out).union(rest.select(*df.columns, out))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): for every node of the edges but the smallest of each component, that smallest node.

    Each round makes every node's larger neighbours, and then its smaller ones, point at the smallest node in reach; the
    edges are written to the shared folder between rounds, so lineage stays short and a lost executor costs one round. Edges never
    leave the executors; the driver sees a count and a checksum. The hub of a large star is a frequent key of with_least().
    """
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not seen.n or (seen.n, seen.h) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        mark = (seen.n, seen.h)
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        large = with_least(both, "a", "b", "low", 2 * seen.n).where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = stored(large.where("a <> b").distinct(), "edges")
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")
        small = with_least(large, "a", "b", "low", 2 * seen.n).select(ends).select("e.a", "e.b")
        now = stored(small.where("a <> b").distinct(), "edges")
