"""Sums over pairs against brute force, and plans that broadcast nothing that explode has multiplied."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfield.functions import stats as st
from lumenfield.operators import annotation as an
from lumenfield.operators import nulls as nu
from lumenfield.operators import pairs as pr
from lumenfield.operators import regions as rg
from lumenfield.operators import spatial as sp

POINTS = "gene string, residue_index int, x double, y double, z double, label int, class string"


def made(n: int = 90) -> pd.DataFrame:
    """Two genes on a coarse lattice, so that many distances equal a radius, with some points in one place."""
    r = np.random.default_rng(5)
    xyz = r.integers(-6, 7, (2 * n, 3)) * 2.5
    xyz[:12] = 1.0
    return pd.DataFrame({"gene": ["A"] * n + ["B"] * n, "residue_index": list(range(1, n + 1)) * 2, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "label": r.integers(0, 3, 2 * n), "class": r.choice(["PLP", "BLB", "-"], 2 * n)})


@pytest.fixture(scope="module")
def table(spark):
    pdf = made()
    u = spark.createDataFrame(pdf, POINTS).cache()
    return pdf, u, u.where("class <> '-'")


@pytest.fixture(autouse=True)
def little(monkeypatch):
    """Groups, tiles and blocks of a few points."""
    for name, size in (("PART", 5), ("TILE", 20), ("WIDE", 8), ("SQUARE", 6), ("HELD", 64)):
        monkeypatch.setattr(pr, name, size)


def distances(g: pd.DataFrame) -> np.ndarray:
    p = g[["x", "y", "z"]].to_numpy()
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))


def test_occupancies(table):
    pdf, u, lab = table
    want = {}
    for gene, g in pdf.groupby("gene"):
        d = distances(g)
        for r in (2.5, 7.5, 10.0):
            n = [(d <= r) @ m for m in (np.ones(len(g), int), (g["class"] != "-").to_numpy(int), (g["class"] == "PLP").to_numpy(int))]
            want |= {(gene, r, i): x for i, *x in zip(g["residue_index"], *n)}
    assert {(r.gene, r.radius, r.residue_index): [r.n_u, r.n_l, r.n_p] for r in sp.occupancies(u, lab, [2.5, 7.5, 10.0]).collect()} == want


def test_ripley_and_spread(table):
    pdf, u, _ = table
    got = {(r.gene, r["class"], r.r): (r.cum, r.shell) for r in sp.ripley(u, u, [2.5, 5.0, 9.0], by=("gene", "class")).collect()}
    far = {r.gene: (r.n_pairs, round(r.d_sum, 6), r.d_max) for r in sp.spread(u).collect()}
    for gene, g in pdf.groupby("gene"):
        d = distances(g)[np.triu_indices(len(g), 1)]
        assert far[gene] == (len(d), round(d.sum(), 6), d.max())
        for c, k in g.groupby("class"):
            d = distances(k)[np.triu_indices(len(k), 1)]
            assert all(got[gene, c, r] == ((d <= r).sum(), ((d > r - 0.5) & (d <= r + 0.5)).sum()) for r in (2.5, 5.0, 9.0))


@pytest.mark.parametrize("edges", [[0.5, 1.0, 2.5, 6.0], [0.3, 1.1, 7.7]])
def test_pair_histogram(edges):
    r = np.random.default_rng(7)
    for n in (0, 1, 2, 7, 40):
        sets, other = r.integers(-4, 5, (3, n, 3)) * 0.5, r.integers(-4, 5, (9, 3)) * 0.5
        got, cross = pr.pair_histogram(sets, None, np.array(edges)), pr.pair_histogram(sets[:1], other, np.array(edges))
        i, j = np.triu_indices(n, 1)
        for k in range(3):
            d = np.sqrt(((sets[k][i] - sets[k][j]) ** 2).sum(axis=1))
            assert got[k].tolist() == np.bincount(np.searchsorted(edges, d), minlength=len(edges) + 1).tolist()
        d = np.sqrt(((sets[0][:, None] - other[None]) ** 2).sum(axis=2)).ravel()
        assert cross[0].tolist() == np.bincount(np.searchsorted(edges, d), minlength=len(edges) + 1).tolist()


def test_tails_follow_the_formula(table):
    _, u, lab = table
    t = nu.exact_tails(u, lab, 7.5)
    i = lambda c: F.col(c).cast("int")
    w = t.join(st.ln_factorials(t.select("gene", "m_all").distinct()), "gene").withColumn("want", st.hypergeometric_tail(i("n_p"), i("m_all"), i("m_good"), i("n_u")))
    assert all(abs(r.p - r.want) < 1e-12 for r in w.collect())


def test_moments_and_covered(table):
    _, u, lab = table
    tested = rg.scan(u, lab, [5.0, 7.5]).cache()
    each = F.explode(F.array(F.lit(5.0), F.lit(7.5))).alias("radius")
    near = sp.range_join(u, lab, 7.5).select("*", each).where("d <= radius")
    want = {(r.gene, r.radius): r.zg for r in nu.label_moments(near, lab).collect()}
    got = {(r.gene, r.radius): r.zg for r in nu.moments(nu.label_weights(u, lab, tested, [5.0, 7.5]), lab).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    some = tested.where("residue_index % 7 = 0")
    inside = sp.range_join(u, u, 7.5).join(some.select("gene", "radius", F.col("residue_index").alias("center")), ["gene", "center"]).where("d <= radius").select("gene", "radius", "point").distinct()
    assert {(r.gene, r.radius): r.n_cov for r in rg.covered_counts(u, lab, some, [5.0, 7.5]).collect()} == {(r.gene, r.radius): r["count"] for r in inside.groupBy("gene", "radius").count().collect()}


def test_positional_null_counts_every_draw(table):
    _, u, lab = table
    n = lab.where("class = 'PLP'").groupBy("gene").agg(F.count(F.lit(1)).alias("n_draw"))
    met = nu.draws(u, n, "s", 9).join(sp.range_join(u, u, 7.5).withColumnRenamed("point", "residue_index"), ["gene", "residue_index"])
    n_b = {(r.gene, r.center, r.b): r["count"] for r in met.groupBy("gene", "center", "b").count().collect()}
    for r in nu.positional_null(u, lab, 7.5, "s", 9).collect():
        x = np.array([n_b.get((r.gene, r.residue_index, b), 0) for b in range(1, 10)])
        assert abs(r.null_mean - x.mean()) < 1e-12 and abs(r.null_sd - x.std(ddof=1)) < 1e-9 and abs(r.p_emp - ((x >= r.n_p).sum() + 1) / 10) < 1e-12


def test_nearest(table):
    pdf, u, lab = table
    got = {(r.gene, r.point): (r.center, r.d) for r in sp.nearest(u, lab).collect()}
    for gene, g in pdf.groupby("gene"):
        d, some = distances(g), np.flatnonzero(g["class"] != "-")
        for i, row in zip(g["residue_index"], d):
            at = some[row[some].argmin()]
            assert got[gene, i] == (g["residue_index"].iloc[at], row[at])
    assert len(got) == len(pdf) and sp.nearest(u, lab.limit(0)).count() == 0


def test_cohesion(table):
    pdf, u, _ = table
    got = {(r.gene, r.label): (r.n, r.mean_distance) for r in an.cohesion(u).collect()}
    for k, g in pdf.groupby(["gene", "label"]):
        assert got[k][0] == len(g) and abs(got[k][1] - distances(g)[np.triu_indices(len(g), 1)].mean()) < 1e-9


def test_no_exploded_side_is_broadcast(spark, table):
    _, u, lab = table
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
        for df in (sp.range_join(u, lab, 5.0), an.shuffled_cohesion(u, "s", 5)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            for side in plan.split("BroadcastExchange")[1:]:
                assert "Generate explode" not in side.split("Exchange", 1)[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_plan_of_candidates_stays_small(spark, small):
    """The driver keeps the text of each plan: what candidates are made from must not be in the plans over them."""
    from lumenfield import queries as q

    plan = q.QUERIES["radius_choice"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 0 and plan.count("Exchange") < 30
