import numpy as np

from lumenfield.llm import neighbours as nb
from pyspark.sql import functions as F


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = min(ok[i], v) if i in ok else v
    out = []
    for q, a in ok.items():
        if q % 20 == 0:
            best = sorted((-float(np.float64(a) @ np.float64(b)), i) for i, b in ok.items() if i != q and len(a) == len(b))[:k]
            out += [(q, r, i) for r, (_, i) in enumerate(best, 1)]
    return sorted(out)


def test_all_found_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(nb, "CANDIDATE_ROWS", 37)
    monkeypatch.setattr(nb, "QUERY_ROWS", 5)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(400)]
    rows += [(i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(400, 520)]  # one vector over and over
    rows += [(600, None), (620, []), (640, [0.0] * 8), (660, [float("nan")] * 8), (680, [None] + [1.0] * 7), (700, [float("inf")] * 8), (None, [1.0] * 8), (720, [1.0, 2.0]), (721, [2.0, 2.0]), (740, [5.0, 1.0, 1.0]), (20, [9.0] * 8), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("dim", F.lit("x"))
    got = nb.nearest(df, F.col("vec_id") % 20 == 0, 7).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == brute(rows, 7)


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(30, 64)), rng.normal(size=(3000, 64)) * rng.lognormal(0, 2, (3000, 1))
    got = nb.tile(np.arange(30) + 10_000, q, np.arange(3000), c, 20)
    want = q @ c.T
    for i, best in enumerate(got):
        assert [v for _, v in best] == np.argsort(-want[i], kind="stable")[:20].tolist()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nb.nearest(df, F.col("vec_id") % 20 == 0).count() == 0


def test_cuts_move_little():
    for rows, queries, tasks in ((10_000, 500, 12), (10_000, 500, 2000), (10**8, 5 * 10**6, 2000), (3, 1, 8), (0, 0, 8)):
        stripes, groups = nb.cuts(rows, queries, 256, tasks)
        assert stripes * groups >= tasks and rows * 256 / stripes <= nb.SIDE_BYTES and queries * 256 / groups <= nb.SIDE_BYTES
    stripes, groups = nb.cuts(10_000, 500, 256, 2000)
    assert groups + 0.05 * stripes < 25  # copies of the table; the least is 2 sqrt(0.05 * 2000) = 20


def test_more_dimensions_than_one_exact_sum_holds(spark):
    v = np.random.default_rng(2).standard_normal((60, 2500)).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nb.nearest(df, F.col("vec_id") % 20 == 0, 7).collect())
    assert got == brute(rows, 7)
