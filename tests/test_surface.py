import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import footprint as fp
from lumenfield.operators import rebuild as rb
from lumenfield.operators import spatial as sp
from lumenfield.operators import surface as sf

POINTS = "gene string, residue_index int, x double, y double, z double"


def grid_of(spark, *rows):
    return spark.createDataFrame(list(rows), "gene string, rho double, h double")


def plain_area(seeds, rho, h):
    """Cell by cell, corner by corner."""
    n = int(rho / h) + 3
    cells = {tuple(s + o for s, o in zip(seed, (x, y, z))) for seed in seeds for x in range(-n, n) for y in range(-n, n) for z in range(-n, n)}
    dist = {}

    def d2(v):
        if v not in dist:
            dist[v] = min(sum((a - b) ** 2 for a, b in zip(v, s)) for s in seeds)
        return dist[v]

    total, n_tri, most = 0.0, 0, int((rho / h) ** 2 + 1e-9)
    for cell in cells:
        corner = [tuple(x + (c >> k & 1) for k, x in enumerate(cell)) for c in range(8)]
        case = sum((d2(v) <= most) << c for c, v in enumerate(corner))
        for tri in sf.triangles(case):
            p = []
            for e in tri:
                a, b = (corner[c] for c in sf.EDGES[e])
                da, db = math.sqrt(d2(a)) * h, math.sqrt(d2(b)) * h
                t = min(1, max(0, (rho - da) / (db - da)))
                p.append([(x + t * (y - x)) * h for x, y in zip(a, b)])
            total += np.linalg.norm(np.cross(np.subtract(p[1], p[0]), np.subtract(p[2], p[0]))) / 2
            n_tri += 1
    return total, n_tri


def test_every_case_closes():
    """In each case every cut edge is in one ring, and mirrored and complementary cases cut the same edges."""
    for case in range(256):
        cut = {e for e, (a, b) in enumerate(sf.EDGES) if (case >> a ^ case >> b) & 1}
        rings = sf._loops(case)
        assert sorted(e for r in rings for e in r) == sorted(cut) and all(len(r) >= 3 for r in rings)
    assert sf.triangles(0) == sf.triangles(255) == [] and len(sf.triangles(1)) == 1 and len(sf.triangles(15)) == 2


def test_area_against_a_plain_loop_and_a_ball(spark):
    rng = random.Random(4)
    pts = [("G", i, *(rng.uniform(0, 6) for _ in "xyz")) for i in range(5)] + [("H", 1, 0.2, -3.0, 40.0), ("H", 2, 30.0, -3.0, 40.0)]
    c = spark.createDataFrame(pts, POINTS)
    got = {r.gene: r for r in sf.surface_area(c, grid_of(spark, ("G", 3.0, 1.0), ("H", 6.0, 0.5))).collect()}
    area, n = plain_area({tuple(math.floor(x + 1e-9) for x in p[2:]) for p in pts if p[0] == "G"}, 3.0, 1.0)
    assert abs(got["G"].area - area) < 1e-9 and got["G"].n_triangles == n
    assert abs(got["H"].area / (2 * 4 * math.pi * 36) - 1) < 0.02  # two balls, apart
    one = sf.surface_area(c.where("gene = 'H' AND residue_index = 1"), grid_of(spark, ("H", 6.0, 0.5))).first()
    assert 0.97 < one.sphericity <= 1.01
    v = fp.voxels(c.where("gene = 'G'"), 3.0, 1.0).select("ix", "iy", "iz", "d2").collect()
    assert sorted(map(tuple, v)) == sorted(map(tuple, sf.inner(sf.field(c, grid_of(spark, ("G", 3.0, 1.0)), 2)).select("ix", "iy", "iz", "d2").collect()))


def test_meshes_are_closed_and_face_outwards(spark, tmp_path):
    c = spark.createDataFrame([("G", 1, 0.0, 0.0, 0.0), ("G", 2, 3.0, 1.0, 0.0)], POINTS)
    vertices, faces = sf.mesh(c, grid_of(spark, ("G", 2.5, 0.5)))
    v = {r.id: (r.x, r.y, r.z) for r in vertices.collect()}
    f = [(r.a, r.b, r.c) for r in faces.collect()]
    assert sorted(v) == list(range(len(v)))
    edges = [e for a, b, c in f for e in ((a, b), (b, c), (c, a))]
    assert len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)
    assert len(v) - len(edges) // 2 + len(f) == 2  # one closed surface without holes
    inside = sum(np.dot(v[a], np.cross(v[b], v[c])) for a, b, c in f) / 6
    assert 0 < inside and abs(inside / (sf.surface_area(c, grid_of(spark, ("G", 2.5, 0.5))).first().volume) - 1) < 0.1
    sf.write_ply(vertices, faces, str(tmp_path / "ply"))
    lines = (next((tmp_path / "ply" / "gene=G").glob("*.txt"))).read_text().splitlines()
    assert lines[0] == "ply" and lines[2] == f"element vertex {len(v)}" and lines[8] == "end_header" and len(lines) == 9 + len(v) + len(f)
    assert lines[9].split() == [f"{x:.6f}" for x in v[0]] and lines[-1].split()[0] == "3"


def test_each_gene_has_an_edge_of_its_own(spark):
    c = spark.createDataFrame([("G", 1, 0.0, 0.0, 0.0), ("H", 1, 0.0, 0.0, 0.0), ("H", 2, 90.0, 90.0, 90.0)], POINTS)
    radii = spark.createDataFrame([("G", 3.0), ("H", 4.0)], "gene string, radius double")
    g = {r.gene: r for r in sf.own_grid(c, radii, most=100_000).collect()}
    assert (g["G"].h, g["G"].n_voxels, g["G"].fell_back) == (0.5, 21**3, False) and (g["H"].h, g["H"].fell_back) == (1.0, True)
    a = {r.gene: r for r in sf.surface_area(c, sf.own_grid(c, radii, most=100_000)).collect()}
    assert abs(a["G"].volume / (4 / 3 * math.pi * 27) - 1) < 0.05 and abs(a["H"].volume / (8 / 3 * math.pi * 64) - 1) < 0.05


@pytest.mark.parametrize("rho,h", [(3.0, 0.5), (4.5, 1.0)])
def test_rebuilds_equal_the_relational_ones(spark, rho, h):
    """Fifty removals, each built anew by joins, against the stamped boxes."""
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 4, (60, 3)), rng.normal(25, 3, (30, 3))])
    u = spark.createDataFrame([("G", i + 1, *map(float, x)) for i, x in enumerate(p)], POINTS).cache()
    labelled = u.withColumn("class", F.when(F.col("residue_index") % 3 == 0, "PLP").when(F.col("residue_index") % 3 == 1, "BLB")).where("class is not null")
    centers = u.where("residue_index % 9 = 1").cache()
    design = fp.removal_design(centers, 60, 7).where("iteration < 50").cache()
    grid = grid_of(spark, ("G", rho, h))
    got = {r.iteration: r for r in rb.with_rates(rb.rebuilt(u, labelled, centers, design, grid, 6.0)).collect()}
    assert len(got) == 50
    every = design.select("iteration", "removed").union(spark.createDataFrame([(-1, [])], "iteration int, removed array<int>"))
    left = every.crossJoin(centers).where(~F.array_contains("removed", F.col("residue_index"))).select("gene", "iteration", *sp.POINT[1:]).cache()
    area = {r.iteration: r for r in sf.surface_area(left, grid, ("gene", "iteration")).collect()}
    v = sf.inner(sf.field(left, grid, 0, ("gene", "iteration")))
    groups = {r.iteration: r.n for r in fp.components(v, ("gene", "iteration")).groupBy("iteration").agg(F.count_distinct("component").alias("n")).collect()}
    near = sp.range_join(centers, u, 6.0).join(left.select("iteration", F.col("residue_index").alias("center")), "center")
    covered, hot = {}, {}
    for r in near.select("iteration", "point", "d").collect():
        hot.setdefault(r.iteration, set()).add(r.point)
        if r.d <= rho:
            covered.setdefault(r.iteration, set()).add(r.point)
    xyz = {i + 1: x for i, x in enumerate(p)}
    whole, whole_area = covered[-1], area[-1]
    for i, r in got.items():
        mine, a = covered.get(i, set()), area[i]
        assert r.n_footprint_residues == len(mine) and abs(r.coverage_fraction - len(mine) / 90) < 1e-12
        assert abs(r.jaccard_residues - len(mine) / len(whole)) < 1e-12 and abs(r.dice_residues - 2 * len(mine) / (len(mine) + len(whole))) < 1e-12
        assert abs(r.volume - a.volume) < 1e-9 and abs(r.volume_ratio - a.volume / whole_area.volume) < 1e-12 and abs(r.volume_delta - (a.volume - whole_area.volume)) < 1e-9
        assert abs(r.jaccard_voxels - a.n_voxels / whole_area.n_voxels) < 1e-12 and abs(r.dice_voxels - 2 * a.n_voxels / (a.n_voxels + whole_area.n_voxels)) < 1e-12
        assert abs(r.surface_area - a.area) < 1e-6 * a.area and abs(r.surface_ratio - a.area / whole_area.area) < 1e-6
        assert r.n_components == groups[i] and r.component_preserved == (groups[i] == groups[-1]) and r.continuity == bool(mine)
        assert abs(r.centroid_shift - np.linalg.norm(np.mean([xyz[k] for k in mine], axis=0) - np.mean([xyz[k] for k in whole], axis=0))) < 1e-9
        far = [min(np.linalg.norm(xyz[k] - xyz[m]) for m in mine) for k in whole]
        assert abs(r.hausdorff95 - np.quantile(far, 0.95)) < 1e-9
        for prefix, inside in (("fp_", mine), ("hot_", hot.get(i, set()))):
            plp, blb = {k for k in xyz if k % 3 == 0}, {k for k in xyz if k % 3 == 1}
            assert [r[f"{prefix}{c}"] for c in ("tp", "fp", "tn", "fn")] == [len(inside & plp), len(inside & blb), len(blb - inside), len(plp - inside)]
        assert abs(r.fp_sensitivity - len(mine & plp) / 30) < 1e-12


def test_nothing_left_is_defined():
    f = rb.Footprint(np.zeros((1, 3)), np.array([[0.0, 0, 1], [0, 0, 9]]), np.array([1, -1]), 2, 2.0, 0.5, 3.0)
    x = dict(zip(rb.GEOMETRY + rb.COUNTS, f.compared(np.array([False]))))
    assert x["jaccard_residues"] == x["dice_voxels"] == x["volume"] == x["continuity"] == 0 and math.isnan(x["surface_area"]) and math.isnan(x["hausdorff95"])
    assert [x[c] for c in rb.COUNTS] == [0, 0, 1, 1, 0, 0, 1, 1]
