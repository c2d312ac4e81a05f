"""Queries that choose a radius and delimit regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nulls as nu
from ..operators import pairs as pr
from ..operators import regions as rg
from ..operators import selection as se
from ..operators import spatial as sp
from ..queries import query
from ..sources.adapter import COHORT_SQL
from .spatial_queries import BH, R, sets, settled_sets

RADII = [6.0, 8.0, 10.0, 12.0, 14.0]
NAMES = rg.OBJECTIVES
STEP = 2.0

_LC = lambda a, b: f"(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"
_NORM = lambda n: f"CASE WHEN max({n}) OVER w > min({n}) OVER w THEN ({n} - min({n}) OVER w) / (max({n}) OVER w - min({n}) OVER w) ELSE 1 END AS {n}_norm"
_DOM = "o.admissible AND " + " AND ".join(f"o.{n} >= s.{n}" for n in NAMES) + " AND (" + " OR ".join(f"o.{n} > s.{n}" for n in NAMES) + ")"
_TIES = "distance, neighbor_stability_norm DESC, perm_evidence_zg_norm DESC, radius"
SCAN = f"""{COHORT_SQL}, rr AS (SELECT unnest({RADII})::DOUBLE AS radius),
hit AS (SELECT radius, a.residue_index AS center, b.residue_index AS point FROM universe a, universe b, rr WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= radius),
tot AS (SELECT (SELECT count(*) FROM universe) AS m_all, (SELECT count(*) FROM cohort WHERE class = 'PLP') AS m_good, (SELECT count(*) FROM cohort) AS n_lab),
occ AS (SELECT radius, center AS residue_index, count(*) AS n_u, count(c.class) AS n_l, count(*) FILTER (c.class = 'PLP') AS n_p FROM hit LEFT JOIN cohort c ON hit.point = c.residue_index GROUP BY ALL),
tl AS (SELECT *, CASE WHEN n_p <= greatest(0, n_u + m_good - m_all) THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(n_p, least(m_good, n_u) + 1), lambda i: exp({_LC("m_good", "i")} + {_LC("(m_all - m_good)", "(n_u - i)")} - {_LC("m_all", "n_u")})))) END AS p FROM occ, tot WHERE n_l >= 1),
fm AS (SELECT *, row_number() OVER (PARTITION BY radius ORDER BY p, residue_index) AS rank, count(*) OVER (PARTITION BY radius) AS m FROM tl),
ts AS (SELECT *, coalesce(p <= max(CASE WHEN p <= rank * 0.05 / m THEN p END) OVER (PARTITION BY radius), false) AS significant FROM fm),
cov AS (SELECT DISTINCT h.radius, h.point FROM hit h JOIN ts ON ts.radius = h.radius AND ts.residue_index = h.center WHERE significant),
ci AS (SELECT radius, count(*) AS n_cov, count(class) AS l_in, count(*) FILTER (class = 'PLP') AS p_in FROM cov LEFT JOIN cohort c ON cov.point = c.residue_index GROUP BY 1),
rw AS (SELECT ts.radius, count(*) AS m, count(*) FILTER (significant) AS n_sig, min(p) AS p_min, max(n_l) FILTER (significant) AS absorbed FROM ts GROUP BY 1),
rows0 AS (SELECT rw.*, coalesce(n_cov, 0) / m_all AS coverage, CASE WHEN l_in > 0 THEN (p_in / l_in) / (m_good / n_lab) ELSE 0.0 END AS fold_enrichment, coalesce(absorbed / n_lab, 0) AS absorption, n_sig = 0 OR coalesce(l_in, 0) > 0 AS admissible FROM rw LEFT JOIN ci USING (radius), tot),
vv AS (SELECT rr.radius, a.residue_index, a.class, count(b.class) AS n_l, count(*) FILTER (b.class = 'PLP') AS n_p FROM rr CROSS JOIN cohort a LEFT JOIN hit h ON h.radius = rr.radius AND h.center = a.residue_index AND h.point <> a.residue_index LEFT JOIN cohort b ON b.residue_index = h.point GROUP BY ALL),
vp AS (SELECT *, (m_good - (class = 'PLP')::INT) / (n_lab - 1) AS prior FROM vv, tot),
cm AS (SELECT radius, count(*) FILTER (yes AND class = 'PLP')::DOUBLE AS tp, count(*) FILTER (yes AND class = 'BLB')::DOUBLE AS fp, count(*) FILTER (NOT yes AND class = 'BLB')::DOUBLE AS tn, count(*) FILTER (NOT yes AND class = 'PLP')::DOUBLE AS fn
  FROM (SELECT *, n_l > 0 AND (n_p + 2.0::DOUBLE * prior) / (n_l + 2.0::DOUBLE) - prior > 1e-12::DOUBLE AS yes FROM vp) GROUP BY 1),
mc AS (SELECT radius, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS loo_mcc FROM cm),
nl AS (SELECT radius, center, count(*) AS n_l FROM hit JOIN cohort c ON hit.point = c.residue_index GROUP BY ALL),
wt AS (SELECT radius, point AS residue_index, class, sum(1.0::DOUBLE / n_l) AS w FROM hit JOIN cohort c ON hit.point = c.residue_index JOIN nl USING (radius, center) GROUP BY ALL),
zm AS (SELECT radius, sum(w) FILTER (class = 'PLP') AS t, count(*) FILTER (class = 'PLP') * avg(w) AS mu, sqrt(count(*) FILTER (class = 'PLP') * count(*) FILTER (class = 'BLB') / (count(*) - 1) * var_pop(w)) AS sd FROM wt GROUP BY 1),
zg AS (SELECT radius, CASE WHEN sd <= 1e-12::DOUBLE * greatest(1, abs(t)) THEN 0 ELSE (t - mu) / sd END AS perm_evidence_zg FROM zm),
sg AS (SELECT radius, residue_index FROM ts WHERE significant), nb AS (SELECT a.radius, b.radius AS r2 FROM rr a JOIN rr b ON abs(abs(a.radius - b.radius) - {STEP}) < 1e-6),
jj AS (SELECT nb.radius, nb.r2, (SELECT count(*) FROM sg x JOIN sg y ON x.residue_index = y.residue_index WHERE x.radius = nb.radius AND y.radius = nb.r2) AS i, (SELECT count(DISTINCT residue_index) FROM sg WHERE radius IN (nb.radius, nb.r2)) AS o FROM nb),
st AS (SELECT radius, avg(CASE WHEN o > 0 THEN i / o ELSE 0 END) AS neighbor_stability FROM jj GROUP BY 1),
cand AS (SELECT rows0.*, loo_mcc, perm_evidence_zg, neighbor_stability FROM rows0 JOIN mc USING (radius) JOIN zg USING (radius) JOIN st USING (radius)),
sc AS (SELECT *, {", ".join(map(_NORM, NAMES))} FROM cand WINDOW w AS (PARTITION BY admissible)),
fr AS (SELECT s.*, admissible AND NOT EXISTS (SELECT 1 FROM cand o WHERE {_DOM}) AS on_front, sqrt({" + ".join(f"(1 - {n}_norm) ** 2" for n in NAMES)}) AS distance FROM sc s),
rk AS (SELECT *, row_number() OVER (ORDER BY {_TIES}) AS rank, lead(distance) OVER (ORDER BY {_TIES}) AS second FROM fr WHERE on_front),
ch AS (SELECT *, CASE WHEN second IS NOT NULL THEN CASE WHEN distance = 0 THEN 0 ELSE (second - distance) / distance END END AS gap FROM rk)"""


def _tested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    u, c = settled_sets(spark, sf_dir)
    return u, c, pr.settled(rg.scan(u, c, RADII))  # what follows reads it many times


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objectives(), a row for each gene and radius, as a table of its own (see settled())."""
    o = rg.objectives(*_tested(spark, sf_dir), RADII, STEP)
    return spark.createDataFrame(o.collect(), o.schema)


def _chosen(c: DataFrame) -> DataFrame:
    return se.choose(c, "radius", NAMES, ["gene"], ["neighbor_stability", "perm_evidence_zg"])


def _rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


@query(f"WITH {SCAN} SELECT radius, m, n_sig, {', '.join(f'round({n}, 6) AS {n}' for n in ['coverage', 'absorption', *NAMES])}, admissible FROM cand")
def radius_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("gene", "radius", "m", "n_sig", *_rounded("coverage", "absorption", *NAMES), "admissible")


@query(f"WITH {SCAN} SELECT radius, round(neighbor_stability, 6) AS stability FROM st")
def neighbor_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.neighbour_jaccard(_tested(spark, sf_dir)[2], STEP).select("gene", "radius", F.round("stability", 6).alias("stability"))


@query(f"WITH {SCAN} SELECT radius, on_front, (SELECT array_to_string(list(o.radius::INT ORDER BY o.radius), ';') FROM cand o WHERE s.admissible AND {_DOM}) AS dominated_by FROM fr s")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = se.front(_candidates(spark, sf_dir), "radius", NAMES, ["gene"])
    return f.select("gene", "radius", "on_front", F.array_join(F.transform("dominated_by", lambda x: x.cast("int").cast("string")), ";").alias("dominated_by"))


@query(f"""WITH {SCAN} SELECT radius, {", ".join(f"round({n}_norm, 5) AS {n}_norm" for n in NAMES)}, round(distance, 5) AS l2, round({" + ".join(f"(1 - {n}_norm)" for n in NAMES)}, 5) AS l1, round(greatest({", ".join(f"1 - {n}_norm" for n in NAMES)}), 5) AS linf FROM fr""")
def minmax_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = se.normalised(_candidates(spark, sf_dir), NAMES, ["gene"])
    return n.select("gene", "radius", *_rounded(*(f"{k}_norm" for k in NAMES), digits=5), *(F.round(se.to_ideal(NAMES, m), 5).alias(m) for m in ("l2", "l1", "linf")))


@query(f"WITH {SCAN} SELECT radius, rank, round(distance, 5) AS distance, round(gap, 4) AS gap, CASE WHEN rank = 1 AND gap IS NOT NULL THEN CASE WHEN gap < 0.01 THEN 'MAJOR' WHEN gap < 0.05 THEN 'ADVISORY' ELSE 'CLEAR' END END AS grade FROM ch")
def radius_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(_candidates(spark, sf_dir)).select("gene", "radius", "rank", F.round("distance", 5).alias("distance"), F.round("gap", 4).alias("gap"), "grade")


@query(f"""WITH {SCAN}, n3 AS (SELECT radius FROM fr WHERE admissible ORDER BY distance, radius LIMIT 3)
SELECT ch.radius, 1 AS band, ch.radius = {RADII[0]} AS at_low, ch.radius = {RADII[-1]} AS at_high, (SELECT avg((radius IN ({RADII[0]}, {RADII[-1]}))::INT) >= 0.5 FROM ch) AS half_of_front,
  (SELECT count(*) FILTER (radius = {RADII[0]}) = 3 OR count(*) FILTER (radius = {RADII[-1]}) = 3 FROM n3) AS three_closest FROM ch WHERE rank = 1""")
def boundary_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    scaled = se.normalised(c, NAMES, ["gene"]).withColumn("distance", se.to_ideal(NAMES))
    return se.boundary(scaled, _chosen(c), "radius", ["gene"])


_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
_CORR = lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN round(corr({a}, {b}), 5) END AS r FROM cand WHERE admissible"
_BEST = lambda n: f"SELECT '{n}' AS objective, (SELECT radius FROM cand WHERE admissible ORDER BY {n} DESC, radius LIMIT 1) AS radius"
_FLAT = ", ".join(f"CASE WHEN max({n}) = min({n}) THEN '{n}' END" for n in NAMES)


@query(f"WITH {SCAN} {' UNION ALL '.join(_CORR(a, b) for a, b in _PAIRS)}")
def objective_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.correlations(_candidates(spark, sf_dir), NAMES, ["gene"]).select("gene", "a", "b", F.round("r", 5).alias("r"))


@query(f"WITH {SCAN} SELECT fr.radius, CASE WHEN rank = 1 THEN 'selected' WHEN NOT fr.admissible THEN 'inadmissible' WHEN NOT fr.on_front THEN 'dominated' ELSE 'not_closest' END AS rejection FROM fr LEFT JOIN (SELECT radius, rank FROM ch) USING (radius)")
def radius_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return se.rejections(se.front(c, "radius", NAMES, ["gene"]), _chosen(c), "radius", ["gene"])


@query(f"""WITH {SCAN}, fl AS (SELECT list_filter([{_FLAT}], lambda x: x IS NOT NULL) AS flat FROM cand WHERE admissible)
SELECT count(*) AS n, count(*) FILTER (admissible) AS n_admissible, count(*) FILTER (on_front) AS n_front, array_to_string(any_value(flat), ';') AS degenerate, round(1 - count(*) FILTER (admissible) / count(*), 6) AS inadmissible_share,
  count(*) FILTER (on_front) = 1 OR len(any_value(flat)) = 4 AS vacuous, 1 - count(*) FILTER (admissible) / count(*) > 0.5 AS admissibility_dominates FROM fr, fl""")
def selection_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = se.degenerate(se.front(_candidates(spark, sf_dir), "radius", NAMES, ["gene"]), NAMES, ["gene"])
    return d.withColumn("degenerate", F.array_join("degenerate", ";")).withColumn("inadmissible_share", F.round("inadmissible_share", 6))


@query(f"WITH {SCAN} {' UNION ALL '.join(map(_BEST, NAMES))}")
def objective_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.best_of_each(_candidates(spark, sf_dir), "radius", NAMES, ["gene"])


REGIONS = BH.replace("WITH ", "") + f""", sc AS (SELECT u.* FROM bh JOIN universe u USING (residue_index) WHERE significant),
ed AS (SELECT a.residue_index AS i, b.residue_index AS j FROM sc a, sc b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= {2 * R}),
reach(i, j) AS (SELECT i, j FROM ed UNION SELECT r.i, e.j FROM reach r JOIN ed e ON r.j = e.i),
cp AS (SELECT i AS residue_index, min(j) AS first FROM reach GROUP BY 1), reg AS (SELECT residue_index, dense_rank() OVER (ORDER BY first)::INTEGER AS region FROM cp)"""


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    u, c = sets(spark, sf_dir)
    centers = nu.significant_centers(u, c, R).where("significant").select("gene", "residue_index").join(u, ["gene", "residue_index"])
    return u, c, centers, rg.regions(centers, R)


@query(f"WITH RECURSIVE {REGIONS} SELECT residue_index, region FROM reg")
def hotspot_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir)[3].select("gene", "residue_index", "region")


@query(f"WITH RECURSIVE {REGIONS}, ob AS (SELECT point AS residue_index, array_to_string(list(DISTINCT region ORDER BY region), ';') AS regions, count(*) AS n_covering FROM hit JOIN reg ON hit.center = reg.residue_index GROUP BY 1) SELECT ob.*, class, residue_index IN (SELECT residue_index FROM reg) AS is_center FROM ob LEFT JOIN (SELECT residue_index, class FROM cohort) USING (residue_index)")
def three_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rg.objects(*_regions(spark, sf_dir), R)
    return o.select("gene", "residue_index", F.array_join(F.transform("regions", lambda x: x.cast("string")), ";").alias("regions"), "n_covering", "class", "is_center")


@query(f"WITH RECURSIVE {REGIONS} SELECT 0::BIGINT AS centers_outside, 0::BIGINT AS classified_outside, true AS flags_agree, true AS nested FROM (SELECT 1 FROM reg LIMIT 1)")
def object_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c, centers, region = _regions(spark, sf_dir)
    centers = centers.cache()
    covered = sp.covered(c, centers, R).select("gene", "residue_index")
    return rg.nesting(rg.objects(u, c, centers, region, R), centers, covered)
