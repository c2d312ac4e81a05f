import numpy as np
import pytest

from lumenfield.llm import topk as tk
from pyspark.sql import functions as F


def brute(rows, k, every=50):
    ok = [(i, [np.floor(min(max(256 * float(x), -tk.MOST), tk.MOST)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % every == 0:
            score = lambda b: min(max(sum(int(x) * int(y) for x, y in zip(a, b)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
            best = sorted((-score(b), i) for m, (i, b) in enumerate(ok) if m != n)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, k, kind="float", every=50):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as score", "'x' as terms", "2 as row")
    return sorted((r.query_id, r.rank, r.key, r.score) for r in tk.top_k(tk.sparse_rows(df), F.col("key") % every == 0, k).collect())


def test_equal_to_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(tk, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 200]) for i in range(400)]  # few values: many ties, many zeros
    rows += [(i, [0.5, 0.25, -0.5, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(400, 560)]  # one vector over and over
    rows += [(600, None), (650, []), (700, [0.0] * 8), (750, [float("nan")] * 8), (800, [None] + [1.0] * 7), (850, [float("inf")] * 8), (None, [1.0] * 8), (900, [1.0, 2.0]), (50, [3.0] * 8), (50, rows[50][1]), (3, rows[3][1])]
    assert found(spark, rows, 7) == brute(rows, 7)


def test_fewer_candidates_than_k_and_no_rows(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [-3.0, 1.0])]
    assert found(spark, rows, 5) == brute(rows, 5)
    assert found(spark, [(50, [1.0])], 5) == []
    assert found(spark, [], 5) == []


def test_sums_beyond_a_long_are_exact_or_at_its_end(spark):
    big = [(i, [1e15 * (i % 5 - 2), 3e13 * i, 1e3, -0.001]) for i in range(60)] + [(100, [1e300, -1e308, 0.0, 0.0]), (101, [1e300, 1e300, 1e308, 0.0])]
    assert found(spark, big, 6, "double") == brute(big, 6)


@pytest.mark.parametrize("partitions", ["3", "50"])
def test_partitioning_changes_nothing(spark, partitions):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(spark, rows, 5) == brute(rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_term_that_few_rows_have_keeps_places(spark):
    rows = spark.createDataFrame([(i, i, [7, 9] if i == 3 else [7], [2.0, 5.0] if i == 3 else [1.0]) for i in range(10)], "row long, key long, terms array<long>, weights array<double>")
    (b,) = tk.build_index(rows).collect()
    assert b.terms == [7, 9] and len(b.weights) == 11 and b.ends == [10, 11] and len(b.at) == 1 and b.at_ends == [0, 1]
    assert b.keys[b.at[0]] == 3
