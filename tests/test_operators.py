"""Operators against their definitions on small made-up inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.functions import stats as st
from lumenfield.functions import variants as v
from lumenfield.operators import annotation as an
from lumenfield.operators import footprint as fp
from lumenfield.operators import nulls as nu
from lumenfield.operators import regions as rg
from lumenfield.operators import selection as se
from lumenfield.operators import spatial as sp


def points(spark, n, seed=1, spread=20.0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([("G", i + 1, *map(float, rng.uniform(-spread, spread, 3))) for i in range(n)], "gene string, residue_index int, x double, y double, z double")


def test_range_join_equals_all_pairs(spark):
    p = points(spark, 80)
    rows = p.collect()
    want = {(a.residue_index, b.residue_index) for a in rows for b in rows if math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) <= 7}
    assert {(r.center, r.point) for r in sp.range_join(p, p, 7.0).collect()} == want
    assert sp.range_join(p.limit(0), p, 7.0).count() == 0


def test_protein_changes(spark):
    cases = {
        "p.Val600Glu": ("V", 600, "E", None), "p.V600E": ("V", 600, "E", None), "p.(Val600Glu)": ("V", 600, "E", None), "p.Val600=": (None, None, None, "hgvs_p_pattern_unmatched"),
        "p.Val600Ter": ("V", 600, None, "nonsense"), "p.Val600fs": (None, None, None, "not_a_substitution:fs"), "p.Lys2_Met3delinsAla": (None, None, None, "not_a_substitution:del"),
        "p.Ter600Glu": (None, 600, None, "reference_is_termination"), "p.Xaa5Gly": (None, 5, None, "non_standard_reference_aa:Xaa"), "p.Val0Glu": ("V", 0, "E", "non_positive_position"),
        "c.1A>T": (None, None, None, "not_protein_level_hgvs"), "": (None, None, None, "empty_protein_hgvs"), None: (None, None, None, "empty_protein_hgvs"),
    }
    cases["p.Val600="] = ("V", 600, "V", "synonymous")
    df = v.with_protein_change(spark.createDataFrame([(c,) for c in cases], "h string"), "h")
    assert {r.h: (r.ref_aa, r.position, r.alt_aa, r.reason) for r in df.collect()} == cases


def test_names(spark):
    cases = {
        "NM_1.4(GENE):c.388A>T (p.Val130Glu)": ("NM_1.4", "GENE", "c.388A>T", "p.Val130Glu"), "NM_1(G):c.1A>T": ("NM_1", "G", "c.1A>T", None), " NM_12.3:c.5del (p.(Val1del)) ": ("NM_12.3", None, "c.5del", "p.(Val1del)"),
        "(p.Ala5Gly)": (None, None, None, "p.Ala5Gly"), "some text (p.Ala5Gly) more": (None, None, None, "p.Ala5Gly"), "NM_x.1(G):c.1A>T": (None, None, None, None), "": (None, None, None, None), None: (None, None, None, None),
    }
    df = v.with_name_parts(spark.createDataFrame([(c,) for c in cases], "name string"), "name")
    assert {r.name: (r.transcript, r.gene_symbol, r.hgvs_c, r.hgvs_p) for r in df.collect()} == cases


def test_benjamini_hochberg_ties(spark):
    p = [0.01, 0.02, 0.02, 0.04, 0.9]
    df = spark.createDataFrame([("G", i, x) for i, x in enumerate(p)], "gene string, residue_index int, p double")
    r = sorted(st.benjamini_hochberg(df).collect(), key=lambda r: r.residue_index)
    m = len(p)
    want = [min(min(p[j] * m / (j + 1) for j in range(i, m)), 1) for i in range(m)]
    assert [round(x.q_bh, 12) for x in r] == [round(x, 12) for x in want]
    assert [x.significant for x in r] == [True, True, True, True, False]


def test_hypergeometric_tail(spark):
    cases = [(k, 30, 8, n) for k in range(0, 9) for n in (1, 5, 12, 30)]
    df = spark.createDataFrame(cases, "k int, m int, g int, n int").crossJoin(st.ln_factorials(spark.createDataFrame([('G', 30)], 'gene string, m_all int')))
    for r in df.withColumn("p", st.hypergeometric_tail(F.col("k"), F.col("m"), F.col("g"), F.col("n"))).collect():
        want = sum(math.comb(8, i) * math.comb(22, r.n - i) for i in range(r.k, 9) if 0 <= r.n - i <= 22) / math.comb(30, r.n)
        assert abs(r.p - want) < 1e-9


def test_pareto_front(spark):
    rng = random.Random(2)
    rows = [("G", float(i), float(rng.randint(0, 5)), float(rng.randint(0, 5)), rng.random() < 0.8) for i in range(40)]
    df = spark.createDataFrame(rows, "gene string, k double, a double, b double, admissible boolean")
    dom = lambda x, y: x[2] >= y[2] and x[3] >= y[3] and (x[2] > y[2] or x[3] > y[3])
    want = {r[1] for r in rows if r[4] and not any(o[4] and dom(o, r) for o in rows)}
    assert {r.k for r in se.front(df, "k", ["a", "b"], ["gene"]).where("on_front").collect()} == want


def test_voxels_components_and_sphere(spark):
    two = spark.createDataFrame([("G", 0.2, 0.2, 0.2), ("G", 40.0, 0.0, 0.0)], "gene string, x double, y double, z double")
    d = fp.descriptors(fp.voxels(two, 5.0, 0.5), 0.5).first()
    assert d.n_components == 2 and d.connectivity == 0.5
    assert abs(d.volume - 2 * 4 / 3 * math.pi * 125) / d.volume < 0.03


def test_regions_chain(spark):
    c = spark.createDataFrame([("G", i, float(i * 3), 0.0, 0.0) for i in range(5)] + [("G", 9, 100.0, 0.0, 0.0)], "gene string, residue_index int, x double, y double, z double")
    assert {r.residue_index: r.region for r in rg.regions(c, 1.5).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 9: 2}


def test_subset_design_and_ranks():
    assert [fp.unrank(r, 5, 3) for r in range(10)] == sorted(fp.unrank(r, 5, 3) for r in range(10))
    full = fp.subset_design(6, 10_000, 1)
    assert len(full) == len(set(full)) == 6 + 15 + 20
    some = fp.subset_design(32, 500, 1)
    assert len(some) <= 500 and len(set(some)) == len(some) and {len(s) for s in some} == set(range(1, 17)) and some == fp.subset_design(32, 500, 1)


def test_bca_covers_the_mean():
    x = np.random.default_rng(5).normal(3, 1, 60)
    low, high = fp.bca(x, 7)
    assert low < x.mean() < high and high - low < 1 and fp.bca(np.ones(4), 7) == (1.0, 1.0)
    assert fp.bca_with_method(x, 7)[2] == "bca" and fp.bca_with_method(np.ones(1), 7)[2] == "undefined" and math.isnan(fp.bca(np.ones(1), 7)[0])


@pytest.mark.parametrize("width", [3, 64])
def test_interval_overlap(spark, width):
    rng = random.Random(4)
    a = [("G", i, s, s + rng.randint(0, 20)) for i, s in enumerate(rng.randint(0, 100) for _ in range(50))]
    b = [("G", i, s, s + rng.randint(0, 30)) for i, s in enumerate(rng.randint(0, 100) for _ in range(20))]
    got = an.overlaps(spark.createDataFrame(a, "gene string, i int, start long, stop long"), spark.createDataFrame(b, "gene string, j int, lo long, hi long"), ["gene"], width)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[1], y[1]) for x in a for y in b if x[2] <= y[3] and x[3] >= y[2])


def voxel_set(spark, cells, gene="G"):
    return spark.createDataFrame([(gene, *map(int, c)) for c in cells], "gene string, ix long, iy long, iz long")


def blob(seed, n=160):
    rng = random.Random(seed)
    cells = {(0, 0, 0)}
    while len(cells) < n:
        c = list(rng.choice(sorted(cells)))
        c[rng.randrange(3)] += rng.choice((-1, 1))
        cells.add(tuple(c))
    return cells


def test_depth_and_erosion_against_all_pairs(spark):
    cells = blob(3) | {(x, y, z) for x in range(8) for y in range(7) for z in range(6)}
    near = {(x + a, y + b, z + c) for x, y, z in cells for a in range(-1, 2) for b in range(-1, 2) for c in range(-1, 2)} - cells
    p = np.array(sorted(cells))
    want = np.array([min(sum((a - b) ** 2 for a, b in zip(v, e)) for e in near) for v in p.tolist()])
    assert (fp._depth2(p) == want).all()
    left = {tuple(r)[1:4] for r in fp.eroded(voxel_set(spark, cells), 2.0, 1.0).select("gene", "ix", "iy", "iz").collect()}
    assert left == {tuple(v) for v, d in zip(p.tolist(), want) if d >= 4}


def test_bridges_and_necks(spark):
    ball = lambda x0: {(x0 + x, y, z) for x in range(-4, 5) for y in range(-4, 5) for z in range(-4, 5) if x * x + y * y + z * z <= 16}
    cells = ball(0) | ball(12) | {(x, 0, 0) for x in range(13)}
    v = voxel_set(spark, cells)
    b = fp.bridges(v, 10.0, 1.0).first()
    assert (b.n_components, b.n_eroded, b.n_bridges, b.bridging_index) == (1, 2, 1, 0.5)
    ask = spark.createDataFrame([("G", 1, 2, 0, 0, 0, 12, 0, 0), ("G", 1, 3, 0, 0, 0, 99, 0, 0), ("G", 1, 4, 0, 0, 0, 1, 0, 0)], "gene string, a int, b int, ax int, ay int, az int, bx int, by int, bz int")
    neck = {(r.a, r.b): r.neck for r in fp.bottlenecks(v, ask, 0.5).collect()}
    assert neck[1, 2] == 0.5 and math.isnan(neck[1, 3]) and neck[1, 4] > 1.5


def test_hull_volumes(spark):
    cube = np.array([(x, y, z) for x in (0, 2) for y in (0, 3) for z in (0, 4)], float)
    rng = np.random.default_rng(2)
    assert abs(fp.hull_volume(np.concatenate([cube, rng.uniform((0, 0, 0), (2, 3, 4), (50, 3))])) - 24) < 1e-9
    assert abs(fp.hull_volume(np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], float)) - 1 / 6) < 1e-12
    assert math.isnan(fp.hull_volume(cube[:3])) and math.isnan(fp.hull_volume(cube * (1, 1, 0)))
    x = rng.normal(size=(400, 3))
    sphere = fp.hull_volume(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert 0.9 * 4 / 3 * math.pi < sphere < 4 / 3 * math.pi
    c = fp.convexity(voxel_set(spark, [(x, y, z) for x in range(4) for y in range(3) for z in range(2)]), 0.5).first()
    assert abs(c.volume - 3.0) < 1e-9 and abs(c.hull - 3 * 2 * 1 * 0.125) < 1e-9 and abs(c.convexity - 4) < 1e-9
    cube = fp.convexity(voxel_set(spark, [(x, y, z) for x in range(3) for y in range(3) for z in range(3)]), 1.0).first()
    assert abs(cube.convexity - 27 / 8) < 1e-9
    flat = fp.convexity(voxel_set(spark, [(x, y, 0) for x in range(3) for y in range(3)]), 1.0).first()
    assert math.isnan(flat.hull) and math.isnan(flat.convexity)


def test_peaks_at_both_ends(spark):
    curve = spark.createDataFrame([("G", float(r), float(g)) for r, g in enumerate([5, 3, 1, 2, 6, 6, 2, 2, 9], 1)], "gene string, r double, g double")
    assert sorted(r.r for r in sp.peaks(curve).collect()) == [1.0, 5.0, 9.0]


def test_sweep_merges_and_groups_against_each_radius(spark):
    c = spark.createDataFrame([("G", i, x, 0.0, 0.0) for i, x in ((3, 0.0), (5, 6.2), (8, 20.0))] + [("H", 1, 0.0, 0.0, 0.0)], "gene string, residue_index int, x double, y double, z double")
    radii = [2.0, 3.0, 4.0, 8.0]
    rows = {(r.gene, r.rho): r for r in fp.sweep(c, c, radii, 1.0).collect()}
    for rho in radii:
        d = {r.gene: r for r in fp.descriptors(fp.voxels(c, rho, 1.0), 1.0).collect()}
        for g in "GH":
            assert (rows[g, rho].n_voxels, rows[g, rho].n_components, rows[g, rho].volume) == (d[g].n_voxels, d[g].n_components, d[g].volume)
    assert [rows["G", r].n_components for r in radii] == [3, 2, 2, 1] and all(r.monotone for r in rows.values())
    assert abs(rows["H", 3.0].expansion_rate - math.log(rows["H", 4.0].n_voxels / rows["H", 2.0].n_voxels) / 2) < 1e-12
    labels = fp.center_labels(c, fp.components(fp.sweep_voxels(c, radii, 1.0), ("gene", "rho")), 1.0)
    assert {(r.rho, r.group, tuple(r.before)) for r in fp.merges(labels).collect()} == {(3.0, 3, (3, 5)), (8.0, 3, (3, 8))}
    v = fp.verdicts(fp.sweep(c, c, radii, 1.0).withColumn("bridging_index", F.lit(0.1))).collect()
    assert all(r.failed == ["F1_COVERAGE"] and not r.admissible and r.escalate for r in v)


def test_removals_against_sets(spark):
    u = points(spark, 60, seed=8).withColumn("gene", F.when(F.col("residue_index") % 2 == 0, "A").otherwise("B"))
    c = u.where("residue_index <= 12")
    rows, centers = u.collect(), c.collect()
    design = fp.removal_design(c, 40, 7)
    ev = c.select("gene", "residue_index").union(u.where("residue_index > 50").select("gene", "residue_index"))
    loss = {(r.gene, r.iteration): r.jaccard for r in fp.removal_iterations(u, c, design, 14.0).collect()}
    wide = {(r.gene, r.iteration): (r.exact, r.binding) for r in fp.containment_iterations(ev, c, u, design).collect()}
    e = {(r.gene, r.residue_index) for r in ev.collect()}
    for d in design.collect():
        left = [x for x in centers if x.gene == d.gene and x.residue_index not in d.removed]
        near = lambda x, some: min(math.dist((x.x, x.y, x.z), (y.x, y.y, y.z)) for y in some)
        own = [x for x in rows if x.gene == d.gene]
        whole = {x.residue_index for x in own if near(x, [y for y in centers if y.gene == d.gene]) <= 14}
        kept = {x.residue_index for x in own if near(x, left) <= 14}
        assert abs(loss[d.gene, d.iteration] - len(kept) / len(whole)) < 1e-12
        far = max((near(x, left), -x.residue_index) for x in own if (x.gene, x.residue_index) in e)
        assert abs(wide[d.gene, d.iteration][0] - far[0]) < 1e-9 and wide[d.gene, d.iteration][1] == -far[1]
    assert {g for g, _ in loss} == {"A", "B"}


def test_containment_fence_decides_nothing(spark):
    d = [1.0] * 10 + [9.5, 12.0]
    ev = spark.createDataFrame([("G", i, 1, x) for i, x in enumerate(d)], "gene string, residue_index int, center int, d double")
    r = fp.containment(ev, 10.0).first()
    assert (r.n, r.n_in, r.exact, r.radius, r.binding, r.binding_is_outlier) == (12, 11, 9.5, 9.5, 10, True)
    assert fp.containment(ev, 0.5).count() == 0


def test_gate_needs_each_category(spark):
    def resolved(**n):
        return spark.createDataFrame([(m, "STRONG") for m, k in n.items() for _ in range(k)], "mechanism string, evidence string")

    assert not an.gate(resolved(Gain=9, Loss=1)).first().passed and not an.gate(resolved(Gain=10, Loss=9)).first().passed
    assert an.gate(resolved(Gain=10, Loss=10)).first().qualifying == "Gain;Loss" and an.gate(resolved(Gain=10, Loss=10, Unclear=30)).first().n_qualifying == 2
    assert not an.gate(resolved(Gain=1).limit(0)).first().passed


def test_resolution_of_evidence(spark):
    cases = {
        "a": ([("Gain", "MODERATE", True), ("Unclear", "STRONG", True)], ("Gain", "MODERATE", False, False, [])),
        "b": ([("Gain", "STRONG", True), ("Loss", "STRONG", True)], ("Mixed", "STRONG", True, False, [])),
        "c": ([("Gain", "MODERATE", True), ("Loss", "MODERATE", True)], ("Unclear", "MODERATE", True, True, [])),
        "d": ([("Gain", "WEAK", True)], ("Unclear", "WEAK", False, False, [])),
        "e": ([("Gain", "NONE", True)], ("Not_Experimentally_Characterized", "NONE", False, False, [])),
        "f": ([("Gain", "STRONG", False)], ("Not_Experimentally_Characterized", "NONE", False, False, [])),
        "g": ([("Unclear", "MODERATE", True)], ("Unclear", "MODERATE", False, False, [])),
        "h": ([("Gain", "STRONG", True), ("Loss", "WEAK", True)], ("Gain", "STRONG", True, False, ["Loss@WEAK"])),
    }
    df = spark.createDataFrame([(k, *r) for k, (rows, _) in cases.items() for r in rows], "k string, mechanism string, evidence string, included boolean")
    got = {r.k: (r.mechanism, r.evidence, r.conflict_flag, r.rubric_gap, r.dissent) for r in an.resolve(df, ["k"]).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}
    with pytest.raises(Exception, match="unknown evidence grade"):
        an.resolve(df.withColumn("evidence", F.lit("SOLID")), ["k"]).collect()


def test_each_gene_has_its_own_radius(spark):
    p = points(spark, 120, seed=4).withColumn("gene", F.when(F.col("residue_index") <= 60, "A").otherwise("B"))
    at = spark.createDataFrame([("A", 5.0), ("B", 12.0)], "gene string, radius double")
    got = {(r.gene, r.center, r.point) for r in sp.within(p, p, at).collect()}
    want = {(r.gene, r.center, r.point) for g, x in (("A", 5.0), ("B", 12.0)) for r in sp.range_join(p.where(F.col("gene") == g), p.where(F.col("gene") == g), x).collect()}
    assert got == want


def test_hausdorff_of_an_empty_side(spark):
    a = points(spark, 5)
    assert math.isnan(fp.hausdorff95(a, a.limit(0)).first().hausdorff95) and fp.hausdorff95(a, a).first().hausdorff95 == 0


def test_exact_label_moments_against_draws(spark):
    u = points(spark, 40, seed=6, spread=9.0)
    lab = u.where("residue_index <= 20").withColumn("class", F.when(F.col("residue_index") <= 8, "PLP").otherwise("BLB"))
    near = sp.range_join(u, lab, 6.0).withColumn("radius", F.lit(6.0))
    exact, drawn = nu.label_moments(near, lab).first(), nu.label_null(u, lab, 6.0, "s", 3000).first()
    assert abs(exact.t_obs - drawn.t_obs) < 1e-9 and abs(exact.t_mean - drawn.t_mean) < 0.1 * exact.t_sd and abs(exact.t_sd / drawn.t_sd - 1) < 0.06


def test_spanning_edges_against_kruskal(spark):
    p = points(spark, 30, seed=9)
    rows = p.collect()
    edges = sorted((math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)), a.residue_index, b.residue_index) for a in rows for b in rows if a.residue_index < b.residue_index)
    root = {r.residue_index: r.residue_index for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = []
    for d, a, b in edges:
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append(d)
    assert np.allclose(sorted(r.d for r in fp.spanning_edges(p).collect()), want)


def test_tiers_and_compositions(spark):
    rows = spark.createDataFrame([("A", 2.0, 0.95, False, 0.2), ("B", 1.2, 0.95, False, 0.2), ("C", 1.2, 0.5, False, 0.2), ("D", 1.0, None, True, 0.4)], "gene string, fold_enrichment double, jaccard_median double, binding_is_outlier boolean, coverage double")
    assert {r.gene: (r.tier, r.regime) for r in an.graded(rows).collect()} == {"A": ("A", "works"), "B": ("B", "works"), "C": ("C", "works"), "D": ("D", "works_with_caveat")}
    m = spark.createDataFrame([("r1", "helix"), ("r1", "coil"), ("r1", "helix"), ("r1", None), ("r2", None)], "g string, kind string")
    assert {r.g: r.composition for r in an.composition(m, ["g"], "kind").collect()} == {"r1": "coil=1;helix=2", "r2": "NA"}
    residues = spark.createDataFrame([("G", 5, ["1", "2"]), ("G", 6, ["9"])], "gene string, residue_index int, record_ids array<string>")
    release = spark.createDataFrame([("G", "1", "", "7", "not provided|Disease A", "RCV1|"), ("G", "2", "X", "8", "Disease B", "")], "gene string, VariationID string, Chromosome string, PositionVCF string, PhenotypeList string, RCVaccession string")
    assert [(r.residue_index, r.VariationID, r.PositionVCF) for r in an.genomic_positions(residues, release).collect()] == [(5, "2", "8")]
    assert {(r.disease, r.reference) for r in an.diseases(residues, release).collect()} == {("Disease A", "RCV1"), ("Disease B", "NA")}
    have, gaps = an.with_gaps(residues.select("gene", "residue_index"), spark.createDataFrame([("G", 5, 1.5)], "gene string, residue_index int, score double"), ["gene", "residue_index"], "not covered")
    assert have.first().score == 1.5 and [(r.residue_index, r.reason) for r in gaps.collect()] == [(6, "not covered")]
