import math

from pyspark.sql import functions as F

from lumenfield import queries as q
from lumenfield.plans import decision_queries as dq
from lumenfield.plans import runs


def planned(n: int, cap: int) -> int:
    """Removals of 1 to min(n - 1, n div 2) of n: all of a size while the cap's even share allows, else as many as the shares leave."""
    sizes, left, total = list(range(1, min(n - 1, n // 2) + 1)), cap, 0
    while sizes:
        size = math.comb(n, sizes.pop(0))
        took = min(size, left // (len(sizes) + 1))
        total, left = total + took, left - took
    return total


def test_iteration_jaccard_takes_all_removals(spark, small):
    centers = {r.gene: r["count"] for r in dq._regions(spark, small)[2].groupBy("gene").count().collect()}
    want = {g: planned(n, runs.DEFAULTS["removals"]) for g, n in centers.items()}
    got = {r.gene: r["count"] for r in q.QUERIES["iteration_jaccard"](spark, small).groupBy("gene").agg(F.count(F.lit(1)).alias("count")).collect()}
    assert got == {g: n for g, n in want.items() if n}
