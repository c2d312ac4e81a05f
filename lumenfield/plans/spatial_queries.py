"""Queries over points: pairs, joins by distance, curves, nulls and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators import nulls as nu
from ..operators import pairs as pr
from ..operators import spatial as sp
from ..queries import query
from ..sources import adapter as ad

R, B, SEED = 10.0, 200, "20250101|scan|r=10"
#: Draws of the queries that take all of them.
FULL = 100_000
GRID = [float(r) for r in range(1, 31)]

C = f"""{ad.COHORT_SQL},
near AS (SELECT a.residue_index AS center, b.residue_index AS point, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM universe a, universe b),
hit AS (SELECT * FROM near WHERE d <= {R}),
occ AS (SELECT center AS residue_index, count(*) AS n_u, count(c.class) AS n_l, count(*) FILTER (c.class = 'PLP') AS n_p FROM hit LEFT JOIN cohort c ON hit.point = c.residue_index GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM universe) AS m_all, (SELECT count(*) FROM cohort WHERE class = 'PLP') AS m_good)"""
_LC = lambda a, b: f"(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"
_TAIL = lambda k: f"""CASE WHEN {k} <= greatest(0, n_u + m_good - m_all) THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(greatest({k}, n_u + m_good - m_all, 0), least(m_good, n_u) + 1), lambda i: exp({_LC("m_good", "i")} + {_LC("(m_all - m_good)", "(n_u - i)")} - {_LC("m_all", "n_u")})))) END"""
TAILS = f"""{C}, tails AS (SELECT *, {_TAIL("n_p")} AS p, {_TAIL("least(m_good, n_u)")} AS p_floor FROM occ, tot)"""
BH = f"""{TAILS}, fam AS (SELECT *, row_number() OVER (ORDER BY p, residue_index) AS rank, count(*) OVER () AS m FROM tails WHERE n_l >= 1),
bh0 AS (SELECT *, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS q_bh, sum(1.0 / rank) OVER () AS h, max(CASE WHEN p <= rank * 0.05 / m THEN p END) OVER () AS edge FROM fam),
bh AS (SELECT *, least(1.0, q_bh * h) AS q_by, coalesce(p <= edge, false) AS significant FROM bh0)"""
DRAWS = f"""{C}, dr0 AS (SELECT residue_index, b, md5(concat_ws('|', '{SEED}', b, residue_index)) AS key FROM universe, (SELECT unnest(range(1, {B + 1})) AS b)),
dr1 AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY key, residue_index) AS rank FROM dr0), draws AS (SELECT b, residue_index FROM dr1, tot WHERE rank <= m_good)"""


def sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = ad.universe(spark, sf_dir)
    return u, ad.cohort(u)


def settled_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """sets() for queries that use them many times."""
    u = pr.settled(ad.universe(spark, sf_dir))
    return u, pr.settled(ad.cohort(u))


@query(f"WITH {C} SELECT count(*) AS n_pairs, round(max(d), 6) AS d_max, floor(max(d) / 2)::BIGINT AS r_max, round(avg(d), 6) AS d_mean FROM near WHERE center < point")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sp.spread(ad.universe(spark, sf_dir))
    return p.select("gene", "n_pairs", F.round("d_max", 6).alias("d_max"), F.floor(F.col("d_max") / 2).alias("r_max"), F.round(F.col("d_sum") / F.col("n_pairs"), 6).alias("d_mean"))


@query(f"WITH {C} SELECT center, point, round(d, 6) AS d FROM hit")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ad.universe(spark, sf_dir)
    return sp.range_join(u, u, R).select("gene", "center", "point", F.round("d", 6).alias("d"))


@query(f"WITH {C} SELECT center, count(*) - 1 AS n_neighbours FROM hit GROUP BY 1")
def neighbours_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ad.universe(spark, sf_dir)
    return sp.range_join(u, u, R).groupBy("gene", "center").agg(F.count_if(F.col("center") != F.col("point")).alias("n_neighbours"))


@query(f"WITH {C} SELECT b.residue_index AS point, arg_min(near.center, near.d) AS center, round(min(near.d), 6) AS d FROM cohort b JOIN near ON near.point = b.residue_index JOIN cohort c ON near.center = c.residue_index WHERE b.class = 'BLB' AND c.class = 'PLP' GROUP BY 1")
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = sets(spark, sf_dir)
    return sp.nearest(c.where("class = 'BLB'"), c.where("class = 'PLP'")).select("gene", "point", "center", F.round("d", 6).alias("d"))


@query(f"WITH {C} SELECT DISTINCT point AS residue_index FROM hit JOIN cohort c ON hit.center = c.residue_index WHERE c.class = 'PLP'")
def covered_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = sets(spark, sf_dir)
    return sp.covered(u, c.where("class = 'PLP'"), R).select("gene", "residue_index")


@query(f"WITH {C} SELECT residue_index FROM universe WHERE residue_index NOT IN (SELECT point FROM hit JOIN cohort c ON hit.center = c.residue_index WHERE c.class = 'PLP')")
def uncovered_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = sets(spark, sf_dir)
    return sp.covered(u, c.where("class = 'PLP'"), R, "left_anti").select("gene", "residue_index")


@query(f"WITH {C} SELECT residue_index, n_u, n_l, n_p FROM occ")
def sphere_occupancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.occupancy(*sets(spark, sf_dir), R).select("gene", "residue_index", "n_u", "n_l", "n_p")


@query(f"WITH {ad.UNIVERSE_SQL} SELECT round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 5) AS radius_of_gyration FROM universe")
def gyration(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sp.gyration(ad.universe(spark, sf_dir))
    return g.select("gene", *(F.round(f"c{c}", 6).alias(f"c{c}") for c in "xyz"), F.round("radius_of_gyration", 5).alias("radius_of_gyration"))


CURVES = f"""{ad.COHORT_SQL}, vol AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS volume FROM universe),
pd AS (SELECT a.class, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM cohort a JOIN cohort b ON a.class = b.class AND a.residue_index < b.residue_index),
nn AS (SELECT class, count(*) AS n FROM cohort GROUP BY 1), grid AS (SELECT unnest(range(1, 31))::DOUBLE AS r),
cc AS (SELECT nn.class, n, r, volume, count(*) FILTER (d <= r) AS cum, count(*) FILTER (d > r - 0.5 AND d <= r + 0.5) AS shell FROM nn JOIN pd ON nn.class = pd.class, grid, vol GROUP BY ALL),
cv AS (SELECT class, r, 2 * cum / n / (n / volume) AS k, cbrt(3 * (2 * cum / n / (n / volume)) / (4 * pi())) AS l, 2 * shell / n / (n / volume * 4 * pi() * r ** 2) AS g FROM cc)"""


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = sets(spark, sf_dir)
    return sp.ripley(c, u, GRID, by=("gene", "class"))


@query(f"WITH {CURVES} SELECT class, r, round(k, 4) AS k, round(l, 6) AS l FROM cv")
def ripley_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curves(spark, sf_dir).select("gene", "class", "r", F.round("k", 4).alias("k"), F.round("l", 6).alias("l"))


@query(f"WITH {CURVES} SELECT class, r, round(g, 6) AS g FROM cv")
def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curves(spark, sf_dir).select("gene", "class", "r", F.round("g", 6).alias("g"))


@query(f"WITH {CURVES}, w AS (SELECT r, g, lag(g) OVER (ORDER BY r) AS a, lead(g) OVER (ORDER BY r) AS b FROM cv WHERE class = 'PLP') SELECT r, round(g, 6) AS g FROM w WHERE (a IS NULL OR g > a) AND (b IS NULL OR g >= b)")
def pcf_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.peaks(_curves(spark, sf_dir).where("class = 'PLP'")).select("gene", "r", F.round("g", 6).alias("g"))


@query(f"WITH {CURVES}, e AS (SELECT r, r - row_number() OVER (ORDER BY r) AS i FROM cv WHERE class = 'PLP' AND g > 1), q AS (SELECT min(r) AS start, max(r) AS stop, count(*) AS n FROM e GROUP BY i) SELECT * FROM q ORDER BY n DESC, start LIMIT 1")
def elevated_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.longest_run(_curves(spark, sf_dir).where("class = 'PLP'"), F.col("g") > 1).select("gene", "start", "stop", "n")


@query(f"WITH {DRAWS} SELECT b, residue_index FROM draws")
def null_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = sets(spark, sf_dir)
    n = c.where("class = 'PLP'").groupBy("gene").agg(F.count(F.lit(1)).alias("n_draw"))
    return nu.draws(u, n, SEED, B).select("gene", "b", "residue_index")


EMPIRICAL = f"""{DRAWS}, nb AS (SELECT center, b, count(*) AS n_b FROM draws JOIN hit ON draws.residue_index = hit.point GROUP BY ALL),
ag AS (SELECT center, sum(n_b)::DOUBLE AS s1, sum(n_b * n_b)::DOUBLE AS s2, count(*) FILTER (n_b >= n_p) AS ge FROM nb JOIN occ ON occ.residue_index = nb.center GROUP BY 1),
em AS (SELECT o.*, coalesce(s1, 0) / {B} AS null_mean, sqrt(greatest(0, coalesce(s2, 0) / {B} - (coalesce(s1, 0) / {B}) ** 2) * {B} / ({B} - 1)) AS null_sd, (CASE WHEN n_p = 0 THEN {B} ELSE coalesce(ge, 0) END + 1) / ({B} + 1) AS p_emp FROM occ o LEFT JOIN ag ON o.residue_index = ag.center)"""


@query(f"WITH {EMPIRICAL} SELECT residue_index, n_p, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(p_emp, 6) AS p_emp, n_l > 0 AND null_sd > 0 AS in_family FROM em")
def positional_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nu.positional_null(*settled_sets(spark, sf_dir), R, SEED, B)
    return n.select("gene", "residue_index", "n_p", *(F.round(c, 6).alias(c) for c in ("null_mean", "null_sd", "p_emp")), "in_family")


LABEL = f"""{C}, lh AS (SELECT center, point FROM hit JOIN cohort c ON c.residue_index = hit.point), nl AS (SELECT center, count(*) AS n_l FROM lh GROUP BY 1),
wt AS (SELECT point AS residue_index, sum(1.0::DOUBLE / n_l) AS w FROM lh JOIN nl USING (center) GROUP BY 1),
ob AS (SELECT sum(w) AS t_obs FROM cohort JOIN wt USING (residue_index) WHERE class = 'PLP'),
d0 AS (SELECT residue_index, b, row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', '{SEED}', b, residue_index)), residue_index) AS rank FROM cohort, (SELECT unnest(range(1, {B + 1})) AS b)),
tb AS (SELECT b, sum(w) AS t FROM d0 JOIN wt USING (residue_index), tot WHERE rank <= m_good GROUP BY 1)"""


@query(f"WITH {LABEL} SELECT round(t_obs, 6) AS t_obs, round((SELECT avg(t) FROM tb), 6) AS t_mean, round((SELECT stddev_samp(t) FROM tb), 6) AS t_sd, round((t_obs - (SELECT avg(t) FROM tb)) / (SELECT stddev_samp(t) FROM tb), 5) AS z FROM ob")
def label_null_zg(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nu.label_null(*sets(spark, sf_dir), R, SEED, B)
    return n.select("gene", *(F.round(c, 6).alias(c) for c in ("t_obs", "t_mean", "t_sd")), F.round("z", 5).alias("z"))


@query(f"WITH {TAILS} SELECT residue_index, n_u, n_p, round(p, 8) AS p, round(p_floor, 8) AS p_floor, round(m_good * n_u / m_all, 6) AS expected FROM tails")
def hypergeom_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nu.exact_tails(*sets(spark, sf_dir), R).select("gene", "residue_index", "n_u", "n_p", F.round("p", 8).alias("p"), F.round("p_floor", 8).alias("p_floor"), F.round("expected", 6).alias("expected"))


@query(f"WITH {BH} SELECT residue_index, n_u, n_l, n_p, round(p, 8) AS p, round(q_bh, 8) AS q_bh, round(q_by, 7) AS q_by, significant FROM bh")
def bh_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nu.significant_centers(*sets(spark, sf_dir), R)
    return t.select("gene", "residue_index", "n_u", "n_l", "n_p", F.round("p", 8).alias("p"), F.round("q_bh", 8).alias("q_bh"), F.round("q_by", 7).alias("q_by"), "significant")


@query(f"WITH {BH} SELECT u.residue_index, round(u.x, 6) AS x, round(u.y, 6) AS y, round(u.z, 6) AS z, n_u, n_l, n_p, round(m_good * n_u / m_all, 6) AS expected, round(p, 8) AS p, round(q_bh, 8) AS q_bh FROM bh JOIN universe u USING (residue_index) WHERE significant")
def significant_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = sets(spark, sf_dir)
    t = nu.significant_centers(u, c, R).where("significant").join(u.select("gene", "residue_index", "x", "y", "z"), ["gene", "residue_index"])
    return t.select("gene", "residue_index", *(F.round(k, 6).alias(k) for k in "xyz"), "n_u", "n_l", "n_p", F.round("expected", 6).alias("expected"), F.round("p", 8).alias("p"), F.round("q_bh", 8).alias("q_bh"))


LOO = f"""{C}, vv AS (SELECT a.residue_index, count(b.residue_index) AS n_l, count(*) FILTER (b.class = 'PLP') AS n_p FROM cohort a LEFT JOIN hit ON hit.center = a.residue_index AND hit.point <> a.residue_index LEFT JOIN cohort b ON b.residue_index = hit.point GROUP BY 1),
lo AS (SELECT c.residue_index, class, n_l, n_p, ((SELECT m_good FROM tot) - (class = 'PLP')::INT) / ((SELECT count(*) FROM cohort) - 1) AS prior FROM cohort c JOIN vv USING (residue_index)),
lp AS (SELECT *, (n_p + 2.0::DOUBLE * prior) / (n_l + 2.0::DOUBLE) AS vote FROM lo), pr AS (SELECT *, CASE WHEN n_l > 0 AND vote - prior > 1e-12::DOUBLE THEN 'PLP' ELSE 'BLB' END AS predicted FROM lp)"""


@query(f"WITH {LOO} SELECT residue_index, class, n_l, n_p, round(vote, 6) AS vote, predicted FROM pr")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nu.leave_one_out(sets(spark, sf_dir)[1], R).select("gene", "residue_index", "class", "n_l", F.col("n_p").cast("long").alias("n_p"), F.round("vote", 6).alias("vote"), "predicted")


@query(f"""WITH {LOO}, m AS (SELECT count(*) FILTER (predicted = 'PLP' AND class = 'PLP') AS tp, count(*) FILTER (predicted = 'PLP' AND class = 'BLB') AS fp, count(*) FILTER (predicted = 'BLB' AND class = 'BLB') AS tn, count(*) FILTER (predicted = 'BLB' AND class = 'PLP') AS fn FROM pr)
SELECT tp, fp, tn, fn, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM m""")
def loo_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = nu.confusion(nu.leave_one_out(sets(spark, sf_dir)[1], R), ["gene"])
    return c.select("gene", "tp", "fp", "tn", "fn", *(F.round(k, 6).alias(k) for k in c.columns[5:]))


@query(f"WITH {TAILS}, f AS (SELECT count(*) AS m, min(p_floor) AS p_floor FROM tails WHERE n_l >= 1) SELECT m, round(greatest(p_floor, 1.0::DOUBLE / {FULL + 1}), 8) AS p_floor, round(0.05::DOUBLE / m, 8) AS c1, round(greatest(p_floor, 1.0::DOUBLE / {FULL + 1}) / (0.05::DOUBLE / m), 5) AS ratio, greatest(p_floor, 1.0::DOUBLE / {FULL + 1}) <= 0.05::DOUBLE / m AS passes, (ceil(1 / (0.05::DOUBLE / m)) - 1)::BIGINT AS b_required FROM f")
def power_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nu.certificate(nu.exact_tails(*sets(spark, sf_dir), R).where("n_l >= 1"), 0.05, FULL)
    return t.select("gene", "m", F.round("p_floor", 8).alias("p_floor"), F.round("c1", 8).alias("c1"), F.round("ratio", 5).alias("ratio"), "passes", "b_required")


@query("WITH s AS (SELECT o_orderkey % 97 AS k FROM orders GROUP BY 1) SELECT concat('scan|r=', k) AS context, ('0x' || substr(sha256(concat('20250101|run|scan|r=', k)), 9, 8))::BIGINT AS seed FROM s")
def seed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ad.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("k")).distinct()
    context = F.concat(F.lit("scan|r="), F.col("k").cast("string"))
    return k.select(context.alias("context"), st.seed(20250101, "run", context).alias("seed"))


@query(f"WITH {BH}, r AS (SELECT rank() OVER (ORDER BY n_u) + (count(*) OVER (PARTITION BY n_u) - 1) / 2 AS rx, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS ry FROM (SELECT n_u, round(p, 9) AS p FROM tails)) SELECT round(corr(rx, ry), 5) AS rho FROM r")
def spearman_size_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nu.exact_tails(*sets(spark, sf_dir), R).withColumn("p", F.round("p", 9))
    return st.spearman(t, "n_u", "p", ["gene"]).select("gene", F.round("rho", 5).alias("rho"))


NULLS = f"""{DRAWS}, vol AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS volume FROM universe), grid AS (SELECT unnest(range(1, 31))::DOUBLE AS r),
pts AS (SELECT b, residue_index, x, y, z FROM draws JOIN universe USING (residue_index) UNION ALL SELECT 0, residue_index, x, y, z FROM cohort WHERE class = 'PLP'),
prs AS (SELECT p.b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM pts p JOIN pts q ON p.b = q.b AND p.residue_index < q.residue_index),
cnt AS (SELECT b, r, count(*) FILTER (d <= r) AS cum, count(*) FILTER (d > r - 0.5 AND d <= r + 0.5) AS shell FROM prs, grid GROUP BY ALL),
cb AS (SELECT b, r, 2 * cum / m_good / (m_good / volume) AS k, cbrt(3 * (2 * cum / m_good / (m_good / volume)) / (4 * pi())) AS l, 2 * shell / m_good / (m_good / volume * 4 * pi() * r ** 2) AS g FROM cnt, tot, vol),
ev AS (SELECT r, avg(k) AS k_mean, stddev_samp(k) AS k_sd, quantile_cont(k, 0.025) AS k_lo, quantile_cont(k, 0.975) AS k_hi, avg(g) AS g_mean, stddev_samp(g) AS g_sd, quantile_cont(g, 0.95) AS g_p95 FROM cb WHERE b > 0 GROUP BY 1),
nc AS (SELECT r, o.k, o.g, k_mean, k_sd, k_lo, k_hi, g_p95, CASE WHEN k_sd > 0 THEN (o.k - k_mean) / k_sd ELSE 0 END AS k_z, CASE WHEN g_sd > 0 THEN (o.g - g_mean) / g_sd ELSE 0 END AS g_z FROM cb o JOIN ev USING (r) WHERE b = 0)"""


def _null_curves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    u, c = settled_sets(spark, sf_dir)
    p = c.where("class = 'PLP'")
    drawn = pr.settled(nu.draws(u, p.groupBy("gene").agg(F.count(F.lit(1)).alias("n_draw")), SEED, B))
    return u, p, drawn, sp.null_curves(p, u, drawn, GRID, B)


@query(f"WITH {NULLS} SELECT r, round(k_lo, 3) AS k_lo, round(k_hi, 3) AS k_hi, round(k_mean, 3) AS k_mean, round(g_p95, 5) AS g_p95, round(k_z, 4) AS k_z, round(g_z, 4) AS g_z FROM nc")
def null_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _null_curves(spark, sf_dir)[3]
    return n.select("gene", "r", *(F.round(c, 3).alias(c) for c in ("k_lo", "k_hi", "k_mean")), F.round("g_p95", 5).alias("g_p95"), *(F.round(c, 4).alias(c) for c in ("k_z", "g_z")))


@query(f"WITH {NULLS}, tb AS (SELECT b, max(abs(CASE WHEN k_sd > 0 THEN (k - k_mean) / k_sd ELSE 0 END)) AS t FROM cb JOIN (SELECT r, k_mean, k_sd FROM ev) USING (r) GROUP BY 1) SELECT round((SELECT t FROM tb WHERE b = 0), 4) AS t_obs, round(((SELECT count(*) FROM tb WHERE b > 0 AND t >= (SELECT t FROM tb WHERE b = 0)) + 1) / ({B} + 1), 6) AS p_global")
def global_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, p, drawn, curves = _null_curves(spark, sf_dir)
    return sp.global_test(p, u, drawn, pr.settled(curves), GRID, B).select("gene", F.round("t_obs", 4).alias("t_obs"), F.round("p_global", 6).alias("p_global"))


@query(f"""WITH {NULLS}, e AS (SELECT r, r - row_number() OVER (ORDER BY r) AS i FROM nc WHERE g > 1 AND g > g_p95), q AS (SELECT min(r) AS a, max(r) AS z, count(*) AS n FROM e GROUP BY i ORDER BY n DESC, a LIMIT 1),
dm AS (SELECT least(25.0::DOUBLE, max(d) / 4) AS cap FROM near), w AS (SELECT cap, a, z, greatest(5.0::DOUBLE, a - 1) AS lo, least(cap, z + 1) AS hi FROM dm LEFT JOIN q ON true),
t AS (SELECT *, list_filter([CASE WHEN a IS NULL THEN 'FT-1' END, CASE WHEN z - a < 2 THEN 'FT-2' END, CASE WHEN floor(round((hi - lo) / 0.5::DOUBLE, 9)) + 1 < 5 THEN 'FT-3' END, CASE WHEN (SELECT m_good FROM tot) < 10 THEN 'FT-4' END], lambda x: x IS NOT NULL) AS fired FROM w)
SELECT round(cap, 6) AS cap, a AS run_start, z AS run_stop, array_to_string(fired, ';') AS triggers, CASE WHEN len(fired) > 0 THEN 'fallback_envelope' ELSE 'pcf_derived' END AS source, CASE WHEN len(fired) > 0 THEN 5.0 ELSE lo END AS lo, round(CASE WHEN len(fired) > 0 THEN cap ELSE hi END, 6) AS hi,
  (floor(round((CASE WHEN len(fired) > 0 THEN cap ELSE hi END - CASE WHEN len(fired) > 0 THEN 5.0::DOUBLE ELSE lo END) / 0.5::DOUBLE, 9)) + 1)::BIGINT AS n_grid FROM t""")
def search_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, p, _, curves = _null_curves(spark, sf_dir)
    d = sp.radius_domain(pr.settled(curves), p, u)
    return d.select("gene", F.round("cap", 6).alias("cap"), "run_start", "run_stop", F.array_join("triggers", ";").alias("triggers"), "source", "lo", F.round("hi", 6).alias("hi"), "n_grid")


_SCOPES = {"overall": "true", "true_PLP": "class = 'PLP'", "true_BLB": "class = 'BLB'", "pred_PLP": "predicted = 'PLP'", "pred_BLB": "predicted = 'BLB'"}
_SCOPE = lambda k, c: f"SELECT '{k}' AS scope, count(*) AS n_residues, count(*) FILTER (n_l = 0) AS n_zero, count(*) FILTER (n_l < 3) AS n_sparse, count(*) FILTER (n_l > 0 AND abs(vote - prior) <= 1e-12::DOUBLE) AS n_tie, round(avg((n_l < 3)::INT), 6) AS share_sparse, min(n_l) AS lowest, round(quantile_cont(n_l, 0.5), 6) AS median, max(n_l) AS highest, round(avg(n_l), 6) AS mean FROM pr WHERE {c} HAVING count(*) > 0"


@query(f"WITH {LOO} {' UNION ALL '.join(_SCOPE(k, c) for k, c in _SCOPES.items())}")
def loo_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nu.sparse_evidence(nu.leave_one_out(sets(spark, sf_dir)[1], R))
    return s.select("gene", "scope", "n_residues", "n_zero", "n_sparse", "n_tie", F.round("share_sparse", 6).alias("share_sparse"), "lowest", F.round("median", 6).alias("median"), "highest", F.round("mean", 6).alias("mean"))


@query(f"""WITH {EMPIRICAL}, fm AS (SELECT p_emp, row_number() OVER (ORDER BY p_emp) AS k, count(*) OVER () AS m FROM em WHERE n_l > 0 AND null_sd > 0), bh AS (SELECT *, coalesce(p_emp <= max(CASE WHEN p_emp <= k * 0.05::DOUBLE / m THEN p_emp END) OVER (), false) AS sig FROM fm),
a AS (SELECT count(*) AS m, count(*) FILTER (abs(p_emp - 1.0::DOUBLE / {B + 1}) <= 1e-15::DOUBLE) AS n_floor, count(*) FILTER (abs(p_emp - 1.0::DOUBLE / {B + 1}) <= 1e-15::DOUBLE AND NOT sig) AS n_lost FROM bh)
SELECT m, n_floor, m / {B + 1}.0 / 0.05 > 1 AS c1, n_floor > 0 AND n_floor < m / {B + 1}.0 / 0.05 AS c2, n_lost > 0 AS c3, (ceil(10 * m / 0.05::DOUBLE) - 1)::BIGINT AS b_required FROM a""")
def resolution_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nu.resolution(nu.positional_null(*settled_sets(spark, sf_dir), R, SEED, B), B).select("gene", "m", "n_floor", "c1", "c2", "c3", "b_required")


@query(f"WITH {C}, nn AS (SELECT (SELECT count(*) FROM cohort) AS n_all, (SELECT m_good FROM tot) AS np), l AS (SELECT DISTINCT n_l::INTEGER AS n_l FROM occ WHERE n_l > 0) SELECT n_l, round(CASE WHEN n_l <= np THEN exp({_LC('np', 'n_l')} - {_LC('n_all', 'n_l')}) ELSE exp({_LC('(n_all - np)', '(n_l - np)')} - {_LC('n_all', 'n_l')}) END, 8) AS p_floor FROM l, nn")
def label_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = sets(spark, sf_dir)
    return nu.label_floors(c, sp.occupancy(u, c, R)).select("gene", "n_l", F.round("p_floor", 8).alias("p_floor"))
