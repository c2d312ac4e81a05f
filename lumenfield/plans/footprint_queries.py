"""Queries over footprints, their robustness, and annotation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotation as an
from ..operators import cohort as co
from ..operators import footprint as fp
from ..operators import regions as rg
from ..operators import spatial as sp
from ..queries import query
from ..sources import adapter as ad
from .decision_queries import REGIONS, _regions
from .spatial_queries import C, R, sets

RHO, H = 4.0, 1.0
EVIDENCE = f"""{REGIONS}, pe AS (SELECT c.residue_index, min(sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2 + (c.z - s.z) ** 2)) AS d, arg_min(s.residue_index, sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2 + (c.z - s.z) ** 2)) AS center FROM cohort c, sc s WHERE class = 'PLP' GROUP BY 1),
fe AS (SELECT count(*) AS n, count(*) FILTER (d <= {R}) AS n_in, max(d) FILTER (d <= {R}) AS exact, quantile_cont(d, 0.25) FILTER (d <= {R}) AS q1, quantile_cont(d, 0.5) FILTER (d <= {R}) AS median, quantile_cont(d, 0.75) FILTER (d <= {R}) AS q3 FROM pe)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c, centers, _ = _regions(spark, sf_dir)
    return fp.evidence(c, centers)


@query(f"WITH RECURSIVE {EVIDENCE} SELECT residue_index, center, round(d, 6) AS d, d <= {R} AS in_evidence FROM pe")
def evidence_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("gene", "residue_index", "center", F.round("d", 6).alias("d"), (F.col("d") <= R).alias("in_evidence"))


@query(f"""WITH RECURSIVE {EVIDENCE} SELECT n, n_in, round(exact, 6) AS exact, ceil(exact / 0.5::DOUBLE) * 0.5::DOUBLE AS radius, (SELECT min(residue_index) FROM pe WHERE d = exact) AS binding, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS fence, exact > q3 + 1.5::DOUBLE * (q3 - q1) AS binding_is_outlier, round((n - n_in) / n, 6) AS share_outside FROM fe WHERE n_in > 0""")
def containment_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fp.containment(_evidence(spark, sf_dir), R)
    return c.select("gene", "n", "n_in", F.round("exact", 6).alias("exact"), F.col("radius").cast("double").alias("radius"), "binding", *(F.round(k, 6).alias(k) for k in ("q1", "median", "q3", "fence")), "binding_is_outlier", F.round("share_outside", 6).alias("share_outside"))


VOXELS = f"""{REGIONS}, sd AS (SELECT DISTINCT floor(x + 1e-9)::BIGINT AS sx, floor(y + 1e-9)::BIGINT AS sy, floor(z + 1e-9)::BIGINT AS sz FROM sc), ax AS (SELECT unnest(range(-4, 5)) AS o),
vx AS (SELECT sx + a.o AS ix, sy + b.o AS iy, sz + c.o AS iz, min(a.o * a.o + b.o * b.o + c.o * c.o) AS d2 FROM sd, ax a, ax b, ax c WHERE a.o * a.o + b.o * b.o + c.o * c.o <= 16 GROUP BY ALL)"""


def _every_gene(spark: SparkSession) -> DataFrame:
    """A row for each gene of the adapter: summaries of centres tell of genes without any, too."""
    return spark.range(1).select(F.explode(F.array(*(F.lit(g) for g in ad.GENES))).alias("gene"))


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.voxels(_regions(spark, sf_dir)[2], RHO, H)


@query(f"WITH RECURSIVE {VOXELS} SELECT d2, count(*) AS n FROM vx GROUP BY 1")
def voxel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(spark, sf_dir).groupBy("gene", F.col("d2").cast("long").alias("d2")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {VOXELS}, st AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(ex, ey, ez)), fc AS (SELECT v.ix, v.iy, v.iz FROM vx v, st WHERE NOT EXISTS (SELECT 1 FROM vx w WHERE w.ix = v.ix + ex AND w.iy = v.iy + ey AND w.iz = v.iz + ez)) SELECT (SELECT count(*) FROM vx) AS n_voxels, count(*) AS n_faces, count(DISTINCT (ix, iy, iz)) AS n_surface FROM fc")
def voxel_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voxels(spark, sf_dir)
    s = fp.surface(v).groupBy("gene").agg(F.sum("open_faces").alias("n_faces"), F.count(F.lit(1)).alias("n_surface"))
    n = v.groupBy("gene").agg(F.count(F.lit(1)).alias("n_voxels"))
    return _every_gene(spark).join(n, "gene", "left").join(s, "gene", "left").fillna(0, ["n_voxels", "n_faces", "n_surface"])


STEPS = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(ex, ey, ez)"
FACES = f"{VOXELS}, fc AS (SELECT v.ix, v.iy, v.iz, v.ix + ex AS nx, v.iy + ey AS ny, v.iz + ez AS nz, NOT EXISTS (SELECT 1 FROM vx w WHERE w.ix = v.ix + ex AND w.iy = v.iy + ey AND w.iz = v.iz + ez) AS is_open FROM vx v, {STEPS})"


@query()
def footprint_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fp.descriptors(_voxels(spark, sf_dir), H)
    return d.select("gene", "n_voxels", "n_components", F.round("volume", 6).alias("volume"), F.round("face_area", 6).alias("face_area"), F.round("connectivity", 6).alias("connectivity"), F.round("compactness", 6).alias("compactness"))


@query(f"WITH RECURSIVE {FACES}, em AS (SELECT DISTINCT nx, ny, nz FROM fc WHERE is_open), er AS (SELECT v.ix, v.iy, v.iz FROM vx v WHERE NOT EXISTS (SELECT 1 FROM em WHERE (v.ix - nx) ** 2 + (v.iy - ny) ** 2 + (v.iz - nz) ** 2 < 4.0 - 1e-9::DOUBLE AND abs(v.ix - nx) <= 2 AND abs(v.iy - ny) <= 2 AND abs(v.iz - nz) <= 2)) SELECT ix, iy, iz FROM er")
def eroded_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.eroded(_voxels(spark, sf_dir), 2.0, H).select("gene", "ix", "iy", "iz")


@query()
def erosion_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.bridges(_voxels(spark, sf_dir), RHO, H, share=0.5).withColumn("bridging_index", F.round("bridging_index", 6))


@query()
def footprint_convexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fp.convexity(_voxels(spark, sf_dir), H)
    return c.select("gene", *(F.round(k, 4).alias(k) for k in ("volume", "hull", "convexity")))


SWEEP = [2.0, 3.0, 4.0, 5.0, 6.0]
_SWEPT = f"""{REGIONS}, sd AS (SELECT DISTINCT floor(x + 1e-9)::BIGINT AS sx, floor(y + 1e-9)::BIGINT AS sy, floor(z + 1e-9)::BIGINT AS sz FROM sc), ax AS (SELECT unnest(range(-6, 7)) AS o),
vx AS (SELECT sx + a.o AS ix, sy + b.o AS iy, sz + c.o AS iz, min(a.o * a.o + b.o * b.o + c.o * c.o) AS d2 FROM sd, ax a, ax b, ax c WHERE a.o * a.o + b.o * b.o + c.o * c.o <= 36 GROUP BY ALL),
rr AS (SELECT unnest({SWEEP})::DOUBLE AS rho), sv AS (SELECT rho, count(*)::DOUBLE AS volume FROM vx, rr WHERE d2 <= rho * rho GROUP BY 1),
nr AS (SELECT u.residue_index, min(sqrt((u.x - s.x) ** 2 + (u.y - s.y) ** 2 + (u.z - s.z) ** 2)) AS d FROM universe u, sc s GROUP BY 1), cv AS (SELECT rho, count(*) FILTER (d <= rho) / count(*) AS coverage FROM nr, rr GROUP BY 1),
sw AS (SELECT rho, volume, coverage, (ln(coalesce(lead(volume) OVER w, volume)) - ln(coalesce(lag(volume) OVER w, volume))) / (coalesce(lead(rho) OVER w, rho) - coalesce(lag(rho) OVER w, rho)) AS rate, volume - lag(volume) OVER w AS delta FROM sv JOIN cv USING (rho) WINDOW w AS (ORDER BY rho))"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, _, centers, _ = _regions(spark, sf_dir)
    return fp.sweep(u, centers.cache(), SWEEP, H)


@query(f"WITH RECURSIVE {_SWEPT} SELECT rho, volume, round(coverage, 6) AS coverage, round(rate, 6) AS expansion_rate, delta AS delta_volume FROM sw")
def radius_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir).select("gene", "rho", "volume", F.round("coverage", 6).alias("coverage"), F.round("expansion_rate", 6).alias("expansion_rate"), "delta_volume")


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    u, _, centers, _ = _regions(spark, sf_dir)
    centers = centers.cache()
    labelled = fp.components(fp.sweep_voxels(centers, SWEEP, H), ("gene", "rho"))
    return u, centers, fp.center_labels(centers, labelled, H)


@query()
def sweep_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir).select("gene", "rho", "n_components", F.round("connectivity", 6).alias("connectivity"), "delta_components", "monotone", "abrupt")


@query()
def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fp.merges(_labels(spark, sf_dir)[2])
    return m.select("gene", "rho", "group", F.array_join(F.transform("before", lambda x: x.cast("string")), ";").alias("before"))


@query()
def merge_necks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every neck that merges made: between neighbours, in the order of their first centres, of the components that one merge joins."""
    _, centers, labels = _labels(spark, sf_dir)
    return fp.merge_necks(centers, labels, fp.sweep_voxels(centers, SWEEP, H), H).select("gene", "rho", "a", "b", F.round("neck", 6).alias("neck"), "connection")


@query()
def sweep_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, _, centers, _ = _regions(spark, sf_dir)
    centers = centers.cache()
    b = fp.bridges(fp.sweep_voxels(centers, SWEEP, H), 4.0, H, ("gene", "rho"))
    rows = fp.sweep(u, centers, SWEEP, H).join(b.select("gene", "rho", "bridging_index"), ["gene", "rho"])
    return fp.verdicts(rows).select("gene", "rho", F.array_join("failed", ";").alias("failed"), "admissible", "escalate")


@query()
def residue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, centers, labels = _labels(spark, sf_dir)
    return fp.residue_components(u, centers, labels, 6.0).select("gene", "residue_index", "center", "group")


@query(f"WITH {C}, p AS (SELECT DISTINCT point AS residue_index FROM hit JOIN cohort c ON hit.center = c.residue_index WHERE c.class = 'PLP'), m AS (SELECT count(*) FILTER (p.residue_index IS NOT NULL AND class = 'PLP') AS tp, count(*) FILTER (p.residue_index IS NOT NULL AND class = 'BLB') AS fp, count(*) FILTER (p.residue_index IS NULL AND class = 'BLB') AS tn, count(*) FILTER (p.residue_index IS NULL AND class = 'PLP') AS fn FROM cohort c LEFT JOIN p USING (residue_index)) SELECT tp, fp, tn, fn, round((SELECT count(*) FROM p) / (SELECT count(*) FROM universe), 6) AS coverage FROM m")
def footprint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = sets(spark, sf_dir)
    inside = sp.covered(u, c.where("class = 'PLP'"), R).select("gene", "residue_index", F.lit("PLP").alias("predicted"))
    share = inside.groupBy("gene").agg(F.count(F.lit(1)).alias("n_in")).join(u.groupBy("gene").agg(F.count(F.lit(1)).alias("n")), "gene")
    from ..operators.nulls import confusion

    m = confusion(c.join(inside, ["gene", "residue_index"], "left").fillna("BLB", ["predicted"]), ["gene"])
    return m.join(share, "gene").select("gene", "tp", "fp", "tn", "fn", F.round(F.col("n_in") / F.col("n"), 6).alias("coverage"))


@query("""WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS sb, (SELECT sum(n) FROM t) AS m)
SELECT round((s - sa * sb / (m * (m - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (m * (m - 1) / 2)), 6) AS ari FROM s""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ad.table(spark, sf_dir, "lineitem").select(F.lit("G1").alias("gene"), "l_returnflag", "l_linestatus")
    return fp.rand_index(t, "l_returnflag", "l_linestatus", ["gene"]).select(F.round("ari", 6).alias("ari"))


@query(f"WITH {C}, ab AS (SELECT a.class AS side, a.residue_index, min(d) AS d FROM near JOIN cohort a ON near.point = a.residue_index JOIN cohort b ON near.center = b.residue_index AND a.class <> b.class GROUP BY ALL) SELECT round(max(q), 6) AS hausdorff95 FROM (SELECT quantile_cont(d, 0.95) AS q FROM ab GROUP BY side)")
def hausdorff95(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = sets(spark, sf_dir)
    return fp.hausdorff95(c.where("class = 'PLP'"), c.where("class = 'BLB'")).select("gene", F.round("hausdorff95", 6).alias("hausdorff95"))


@query()
def mst_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fp.spanning_edges(_regions(spark, sf_dir)[2].select("gene", "residue_index", "x", "y", "z"))
    return e.groupBy("gene").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.max("d"), 6).alias("longest"), F.round(F.avg("d"), 6).alias("mean"))


LOCO = f"""{REGIONS}, nc AS (SELECT center, point FROM hit JOIN sc ON sc.residue_index = hit.center), np AS (SELECT point, count(*) AS n FROM nc GROUP BY 1), lo AS (SELECT center AS removed, count(*) FILTER (n = 1) AS n_lost, (SELECT count(*) FROM np) AS n_all FROM nc JOIN np USING (point) GROUP BY 1)"""


def _loco(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, _, centers, _ = _regions(spark, sf_dir)
    return fp.leave_one_center_out(u, centers, R)


@query(f"WITH RECURSIVE {LOCO} SELECT removed, n_lost, n_all, round((n_all - n_lost) / n_all, 6) AS jaccard, round(2 * (n_all - n_lost) / (2 * n_all - n_lost), 6) AS dice FROM lo")
def leave_one_center_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loco(spark, sf_dir).select("gene", "removed", "n_lost", "n_all", F.round("jaccard", 6).alias("jaccard"), F.round("dice", 6).alias("dice"))


@query(f"WITH RECURSIVE {LOCO} SELECT removed, row_number() OVER (ORDER BY (n_all - n_lost) / n_all, removed) AS rank FROM lo")
def center_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loco(spark, sf_dir).select("gene", "removed", "rank")


@query(f"WITH RECURSIVE {LOCO}, j AS (SELECT (n_all - n_lost) / n_all AS j FROM lo) SELECT count(*) AS n, round(avg(j), 6) AS mean, round(min(j), 6) AS lowest, round(quantile_cont(j, 0.5), 6) AS median, round(avg((j >= 0.99)::INT), 6) AS preserved FROM j")
def preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("jaccard")
    p = _loco(spark, sf_dir).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(j), 6).alias("mean"), F.round(F.min(j), 6).alias("lowest"), F.round(F.percentile(j, 0.5), 6).alias("median"), F.round(F.avg((j >= 0.99).cast("int")), 6).alias("preserved"))
    return _every_gene(spark).join(p, "gene", "left").fillna(0, ["n"])


@query()
def iteration_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, _, centers, _ = _regions(spark, sf_dir)
    design = fp.removal_design(centers, 10_000, 20250101)
    return fp.removal_iterations(u, centers, design, R).select("gene", "iteration", "k", F.round("jaccard", 6).alias("jaccard"))


@query()
def iteration_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containment radius that each of the removals would give, of the frozen evidence set."""
    u, c, centers, _ = _regions(spark, sf_dir)
    centers = centers.cache()
    ev = fp.evidence(c, centers).where(F.col("d") <= R)
    i = fp.containment_iterations(ev, centers, u, fp.removal_design(centers, 10_000, 20250101))
    return i.select("gene", "iteration", F.round("exact", 6).alias("exact"), F.col("radius").cast("double").alias("radius"), "binding")


_STATS = lambda c: f"count(*) AS n_total, count({c}) AS n_valid, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(stddev_samp({c}) / abs(avg({c})), 6) AS cv, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(min({c}), 6) AS lowest, round(max({c}), 6) AS highest"


@query(f"WITH RECURSIVE {LOCO}, j AS (SELECT (n_all - n_lost) / n_all AS jaccard, 2 * (n_all - n_lost) / (2 * n_all - n_lost) AS dice FROM lo) SELECT 'jaccard' AS metric, {_STATS('jaccard')} FROM j UNION ALL SELECT 'dice', {_STATS('dice')} FROM j")
def robustness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fp.aggregated(_loco(spark, sf_dir), ["jaccard", "dice"])
    every = _every_gene(spark).select("gene", F.explode(F.array(F.lit("jaccard"), F.lit("dice"))).alias("metric"))
    a = every.join(a, ["gene", "metric"], "left").fillna(0, ["n_total", "n_valid"])
    return a.select("gene", "metric", "n_total", "n_valid", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "cv", "q1", "median", "q3", "lowest", "highest")))


@query()
def bca_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high, method = fp.bca_with_method(pdf["jaccard"].sort_values().to_numpy(), 20250101)
        return pd.DataFrame({"gene": [pdf["gene"].iloc[0]], "low": [round(low, 6)], "high": [round(high, 6)], "method": [method]})

    return _loco(spark, sf_dir).select("gene", "jaccard").groupBy("gene").applyInPandas(kernel, "gene string, low double, high double, method string")


DOMAINS = "dm AS (SELECT p_partkey AS domain_id, (p_partkey % 500)::BIGINT AS start, (p_partkey % 500 + p_size)::BIGINT AS stop FROM part)"


@query(f"WITH RECURSIVE {REGIONS}, {DOMAINS}, sp AS (SELECT region, min(residue_index)::BIGINT AS lo, max(residue_index)::BIGINT AS hi FROM reg GROUP BY 1) SELECT region, domain_id, start, stop FROM sp JOIN dm ON start <= hi AND stop >= lo")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _regions(spark, sf_dir)[3].groupBy("gene", "region").agg(F.min("residue_index").cast("long").alias("lo"), F.max("residue_index").cast("long").alias("hi"))
    at = F.col("p_partkey") % 500
    domains = ad.table(spark, sf_dir, "part").select(F.explode(F.array(*(F.lit(g) for g in ad.GENES))).alias("gene"), F.col("p_partkey").alias("domain_id"), at.cast("long").alias("start"), (at + F.col("p_size")).cast("long").alias("stop"))
    return an.overlaps(domains, spans, ["gene"]).select("gene", "region", "domain_id", "start", "stop")


NAMES = ["Gain", "Loss", "Dominant_Negative", "Mixed", "Unclear", "Not_Experimentally_Characterized"]
RUBRIC = """rc AS (SELECT doc_id % 60 AS residue_index, ((doc_id * 7 + quality + toxic) % 4) AS tier, ['Gain', 'Loss', 'Dominant_Negative', 'Unclear'][1 + (doc_id // 60) % 4] AS mechanism, doc_id % 11 <> 0 AS included FROM documents JOIN labels USING (doc_id)),
ra AS (SELECT *, included AND tier > 0 AND mechanism <> 'Unclear' AS asserts FROM rc), rt AS (SELECT *, max(tier) FILTER (asserts) OVER (PARTITION BY residue_index) AS top FROM ra),
nm AS (SELECT residue_index, max(top) AS top, max(tier) FILTER (included) AS seen, count(*) FILTER (included) AS n_records, list(DISTINCT mechanism ORDER BY mechanism) FILTER (asserts AND tier = top) AS names FROM rt GROUP BY 1),
lw AS (SELECT residue_index, list(DISTINCT concat(rt.mechanism, '@', ['NONE', 'WEAK', 'MODERATE', 'STRONG'][rt.tier + 1]) ORDER BY concat(rt.mechanism, '@', ['NONE', 'WEAK', 'MODERATE', 'STRONG'][rt.tier + 1])) AS dissent FROM rt JOIN nm USING (residue_index) WHERE asserts AND rt.tier < nm.top AND nm.top >= 2 AND NOT list_contains(names, rt.mechanism) GROUP BY 1),
rs AS (SELECT residue_index, CASE WHEN coalesce(seen, 0) = 0 THEN 'Not_Experimentally_Characterized' WHEN top IS NULL OR top < 2 THEN 'Unclear' WHEN len(names) = 1 THEN names[1] WHEN top = 3 THEN 'Mixed' ELSE 'Unclear' END AS mechanism,
  ['NONE', 'WEAK', 'MODERATE', 'STRONG'][coalesce(top, seen, 0) + 1] AS evidence, coalesce(len(names) > 1, false) OR dissent IS NOT NULL AS conflict_flag, coalesce(top = 2 AND len(names) > 1, false) AS rubric_gap, coalesce(array_to_string(dissent, ';'), '') AS dissent, n_records FROM nm LEFT JOIN lw USING (residue_index))"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.table(spark, sf_dir, "documents").select("doc_id").join(ad.table(spark, sf_dir, "labels"), "doc_id")
    pick = lambda names, at: F.element_at(F.array(*(F.lit(n) for n in names)), (at + 1).cast("int"))
    tier = (F.col("doc_id") * 7 + F.col("quality") + F.col("toxic")) % 4
    r = d.select((F.col("doc_id") % 60).alias("residue_index"), pick(an.GRADES, tier).alias("evidence"), pick([*NAMES[:3], "Unclear"], F.floor(F.col("doc_id") / 60) % 4).alias("mechanism"), (F.col("doc_id") % 11 != 0).alias("included"))
    return an.resolve(r, ["residue_index"])


@query(f"WITH {RUBRIC} SELECT * FROM rs")
def mechanism_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).withColumn("dissent", F.array_join("dissent", ";"))


@query(f"WITH {RUBRIC} SELECT m AS mechanism, count(rs.mechanism) AS n FROM (SELECT unnest({NAMES}) AS m) LEFT JOIN rs ON rs.mechanism = m GROUP BY 1")
def mechanism_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.counts(_resolved(spark, sf_dir), NAMES)


@query(f"WITH {RUBRIC}, g AS (SELECT mechanism, count(*) AS n FROM rs WHERE evidence IN ('MODERATE', 'STRONG') AND mechanism NOT IN ('Unclear', 'Not_Experimentally_Characterized') GROUP BY 1) SELECT coalesce(sum(n), 0)::BIGINT AS n_variants, count(*) FILTER (n >= 10) AS n_qualifying, coalesce(string_agg(mechanism, ';' ORDER BY mechanism) FILTER (n >= 10), '') AS qualifying, count(*) FILTER (n >= 10) >= 2 AS passed FROM g")
def posthoc_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.gate(_resolved(spark, sf_dir))


@query(f"WITH {C}, l AS (SELECT residue_index, label FROM universe) SELECT a.label, (SELECT count(*) FROM l WHERE l.label = a.label) AS n, round(avg(d), 6) AS mean_distance FROM near JOIN l a ON a.residue_index = center JOIN l b ON b.residue_index = point WHERE center < point AND a.label = b.label GROUP BY 1")
def cohesion_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ad.universe(spark, sf_dir)
    return an.cohesion(u).select("gene", "label", "n", F.round("mean_distance", 6).alias("mean_distance"))


@query(f"WITH RECURSIVE {REGIONS} SELECT residue_index, CASE WHEN plddt < 50 THEN 'no_confident_position' ELSE 'no_structure_code' END AS reason FROM reg JOIN universe u USING (residue_index) WHERE residue_index % 5 = 0")
def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, _, _, region = _regions(spark, sf_dir)
    known = u.where("residue_index % 5 <> 0").select("gene", "residue_index")  # residues with a structure code
    gaps = region.join(known, ["gene", "residue_index"], "left_anti").join(u.select("gene", "residue_index", "plddt"), ["gene", "residue_index"])
    return gaps.select("gene", "residue_index", F.when(F.col("plddt") < 50, "no_confident_position").otherwise("no_structure_code").alias("reason"))


SHUFFLES = 199


@query(f"""WITH {C}, real AS (SELECT 0 AS b, residue_index, label FROM universe),
ord AS (SELECT b, residue_index, row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', 'posthoc', b, residue_index)), residue_index) AS n FROM universe, (SELECT unnest(range(1, {SHUFFLES + 1})) AS b)),
lab AS (SELECT label, row_number() OVER (ORDER BY label, residue_index) AS n FROM universe), every AS (SELECT * FROM real UNION ALL SELECT b, residue_index, label FROM ord JOIN lab USING (n)),
t AS (SELECT x.label, x.b, avg(d) AS t FROM near JOIN every x ON x.residue_index = center JOIN every y ON y.residue_index = point AND y.b = x.b AND y.label = x.label WHERE center < point GROUP BY ALL),
o AS (SELECT label, t AS observed FROM t WHERE b = 0), nl AS (SELECT o.label, any_value(observed) AS observed, count(*) AS n_valid, avg(t) AS null_mean, stddev_samp(t) AS null_sd, (count(*) FILTER (t <= observed) + 1) / (count(*) + 1) AS p FROM t JOIN o USING (label) WHERE b > 0 GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY p, label) AS k, count(*) OVER () AS m FROM nl)
SELECT label, n_valid, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_bh,
  coalesce(p <= max(CASE WHEN p <= k * 0.05::DOUBLE / m THEN p END) OVER (), false) AS significant FROM rk""")
def label_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ad.universe(spark, sf_dir)
    s = an.shuffled_cohesion(u.select(*sp.POINT, "label"), "posthoc", SHUFFLES)
    return s.select("gene", "label", "n_valid", *(F.round(c, 6).alias(c) for c in ("observed", "null_mean", "null_sd", "p", "q_bh")), "significant")


@query(f"WITH RECURSIVE {REGIONS}, ob AS (SELECT DISTINCT region, point AS residue_index FROM hit JOIN reg ON hit.center = reg.residue_index), k AS (SELECT region, CASE WHEN plddt < 50 THEN 'very_low' WHEN plddt < 70 THEN 'low' WHEN plddt < 90 THEN 'confident' ELSE 'very_high' END AS band, count(*) AS n FROM ob JOIN universe USING (residue_index) GROUP BY ALL) SELECT region, string_agg(concat(band, '=', n), ';' ORDER BY band) AS composition FROM k GROUP BY 1")
def region_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c, centers, region = _regions(spark, sf_dir)
    o = rg.objects(u, c, centers, region, R).select("gene", "residue_index", F.explode("regions").alias("region"))
    banded = u.select("gene", "residue_index", co.band(F.col("plddt"), [50, 70, 90], ["very_low", "low", "confident", "very_high"]).alias("band"))
    return an.composition(o.join(banded, ["gene", "residue_index"]), ["gene", "region"], "band")
