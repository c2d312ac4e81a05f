"""Queries over raw records: parsing, classification, eligibility, collapse and proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import variants as v
from ..operators import cohort as co
from ..queries import query
from ..sources import adapter as ad

_NS = ", ".join(f"'{t}'" for t in v.NON_SUBSTITUTION)
_AA = "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in [*v.AA3.items(), *((x, x) for x in v.AA3.values())]) + "}"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_SQUEEZE = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"

PARSED = f"""{ad.RECORDS_CTE},
p0 AS (SELECT *, trim(name) AS t, strpos(trim(name), '(p.') AS cut_at FROM records),
p1 AS (SELECT *, trim(CASE WHEN cut_at > 0 THEN substr(t, 1, cut_at - 1) ELSE t END) AS front, substr(t, cut_at + 1) AS back FROM p0),
p2 AS (SELECT *, CASE WHEN starts_with(front, 'NM_') THEN split_part(split_part(front, ':', 1), '(', 1) END AS transcript,
  CASE WHEN starts_with(front, 'NM_') THEN nullif(substr(front, length(split_part(front, ':', 1)) + 2), '') END AS hgvs_c,
  CASE WHEN cut_at > 0 THEN CASE WHEN back LIKE '%)' THEN substr(back, 1, length(back) - 1) ELSE split_part(back, ')', 1) END END AS hgvs_p FROM p1),
p3 AS (SELECT *, coalesce(hgvs_p, '') AS h, lower(substr(coalesce(hgvs_p, ''), 3)) AS body, trim(substr(coalesce(hgvs_p, ''), 3), '()') AS bare FROM p2),
p31 AS (SELECT *, regexp_split_to_array(bare, '[0-9]+') AS cut, TRY_CAST(regexp_extract(bare, '[0-9]+') AS INTEGER) AS pos0 FROM p3),
p32 AS (SELECT *, coalesce(cut[1], '') AS r3, coalesce(cut[2], '') AS a3, len(cut) = 2 AND length(cut[1]) IN (1, 3) AND length(cut[2]) IN (1, 3) AS ok FROM p31),
p4 AS (SELECT *, {_AA}[upper(r3)] AS ra, {_AA}[upper(a3)] AS aa, list_filter([{_NS}], lambda x: contains(body, x))[1] AS ns FROM p32),
p5 AS (SELECT *, CASE WHEN h = '' THEN 'empty_protein_hgvs' WHEN NOT starts_with(h, 'p.') THEN 'not_protein_level_hgvs' WHEN ns IS NOT NULL THEN 'not_a_substitution:' || ns WHEN NOT ok THEN 'hgvs_p_pattern_unmatched'
  WHEN upper(r3) IN ('TER', '*', 'TRM') THEN 'reference_is_termination' WHEN ra IS NULL THEN 'non_standard_reference_aa:' || r3 WHEN a3 = '=' THEN 'synonymous' WHEN upper(a3) IN ('TER', '*', 'TRM') THEN 'nonsense'
  WHEN aa IS NULL THEN 'non_standard_alternate_aa:' || a3 WHEN aa = ra THEN 'synonymous' WHEN pos0 < 1 THEN 'non_positive_position' END AS reason FROM p4),
parsed AS (SELECT k, concat(variation_id, CASE WHEN row_number() OVER (PARTITION BY variation_id ORDER BY k) > 1 THEN concat('-', row_number() OVER (PARTITION BY variation_id ORDER BY k)) ELSE '' END) AS record_id, name, clinical_significance, review_status, transcript, hgvs_c, hgvs_p, reason IS NULL AS is_missense, reason,
  CASE WHEN ns IS NULL AND ok THEN pos0 END AS position, CASE WHEN ns IS NULL AND ok THEN ra END AS ref_aa, CASE WHEN ns IS NULL AND ok AND ra IS NOT NULL THEN CASE WHEN a3 = '=' THEN ra ELSE aa END END AS alt_aa FROM p5)"""


def _significance(policy: str) -> str:
    norm = f"[{_SQUEEZE('clinical_significance')}]" if policy == "whole_field" else f"list_transform(parts, lambda x: {_SQUEEZE('x')})"
    low = lambda xs: _LIST([x.lower() for x in xs])
    return f"""
s0 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(clinical_significance, ''), '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS parts, {_SQUEEZE("clinical_significance")} AS w FROM parsed),
s1 AS (SELECT *, {norm} AS norm FROM s0),
s2 AS (SELECT *, list_has_any(norm, {low(v.PATHOGENIC)}) AS ip, list_has_any(norm, {low(v.BENIGN)}) AS ib FROM s1),
sig AS (SELECT *, CASE WHEN ip AND ib THEN 'RECORD_SIGNIFICANCE_CONFLICT' WHEN ip THEN 'PLP' WHEN ib THEN 'BLB' WHEN regexp_matches(w, '{"|".join(v.CONFLICTING)}') THEN 'CONFLICTING'
    WHEN list_has_any(norm, {_LIST(v.VUS_LABELS)}) OR contains(w, 'uncertain') THEN 'VUS' ELSE 'OTHER' END AS class,
  (ip <> ib) AND list_contains({low(v.PATHOGENIC + v.BENIGN)}, w) AS exact_match,
  CASE WHEN ip <> ib THEN list_filter(parts, lambda x: NOT list_contains({low(v.PATHOGENIC + v.BENIGN)}, {_SQUEEZE("x")})) ELSE parts END AS modifiers FROM s2)"""


_STARS = "MAP {" + ", ".join(f"'{k}': {n}" for k, n in v.STARS.items()) + "}"
EVALS = f"""{PARSED}, {_significance("whole_field")}, {ad.UNIVERSE_SQL},
e0 AS (SELECT s.*, u.aa AS aa_ref, (SELECT max(residue_index) FROM universe) AS len, split_part(trim(coalesce(transcript, '')), '.', 1) IN ('NM_900001', 'ENST00000900001') AS on_mane FROM sig s LEFT JOIN universe u ON s.position = u.residue_index),
e1 AS (SELECT *, list_filter([
  CASE WHEN NOT is_missense AND reason IN ({", ".join(f"'{r}'" for r in v.CLEAN_NON_MISSENSE)}) THEN {{'rank': 1, 'reason': 'non_missense_variant_type', 'detail': reason}} WHEN NOT is_missense THEN {{'rank': 0, 'reason': 'unparseable_hgvs', 'detail': reason}} END,
  CASE WHEN is_missense AND aa_ref IS NULL THEN {{'rank': 3, 'reason': 'ref_aa_mismatch', 'detail': concat('position_out_of_range:', position, '>', len)}}
    WHEN is_missense AND aa_ref <> ref_aa THEN {{'rank': CASE WHEN on_mane THEN 3 ELSE 2 END, 'reason': CASE WHEN on_mane THEN 'ref_aa_mismatch' ELSE 'non_canonical_transcript' END, 'detail': concat('hgvs_ref=', ref_aa, ';uniprot_ref=', aa_ref, ';transcript=', coalesce(transcript, 'NA'))}} END,
  CASE WHEN class NOT IN ('PLP', 'BLB') THEN {{'rank': CASE class WHEN 'VUS' THEN 4 WHEN 'OTHER' THEN 6 ELSE 5 END, 'reason': CASE class WHEN 'VUS' THEN 'vus' WHEN 'OTHER' THEN 'non_binary_significance' ELSE 'conflicting' END, 'detail': 'significance_class=' || class}} END], lambda x: x IS NOT NULL) AS whys FROM e0),
evals AS (SELECT record_id, clinical_significance, review_status, {_STARS}[{_SQUEEZE("review_status")}] AS star_level, transcript, hgvs_p, ref_aa, alt_aa, aa_ref, CASE WHEN is_missense THEN position END AS residue_index, class AS significance_class, exact_match, on_mane,
  is_missense AND coalesce(aa_ref = ref_aa, false) AND NOT on_mane AS remapped, len(whys) = 0 AS eligible, list_sort(whys)[1].reason AS exclusion_reason, coalesce(list_sort(whys)[1].detail, 'NA') AS exclusion_detail FROM e1),
residues AS (SELECT residue_index, aa_ref, count(*) FILTER (significance_class = 'PLP') AS n_records_plp, count(*) FILTER (significance_class = 'BLB') AS n_records_blb, list(record_id ORDER BY record_id) AS record_ids, max(star_level) AS max_star FROM evals WHERE eligible GROUP BY ALL),
residues2 AS (SELECT *, CASE WHEN n_records_plp > 0 AND n_records_blb > 0 THEN 'CONFLICT' WHEN n_records_plp > 0 THEN 'PLP' ELSE 'BLB' END AS class FROM residues),
evals2 AS (SELECT e.* REPLACE (CASE WHEN eligible AND b.residue_index IS NOT NULL THEN 'residue_class_conflict' ELSE exclusion_reason END AS exclusion_reason,
  CASE WHEN eligible AND b.residue_index IS NOT NULL THEN concat('residue_index=', e.residue_index) ELSE exclusion_detail END AS exclusion_detail, eligible AND b.residue_index IS NULL AS eligible)
  FROM evals e LEFT JOIN (SELECT residue_index FROM residues2 WHERE class = 'CONFLICT') b ON e.residue_index = b.residue_index)"""


def _evals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(judgements after collapse, residues)."""
    evals = co.evaluated(ad.raw_records(spark, sf_dir), ad.universe(spark, sf_dir))
    residues = co.collapsed(evals)
    return co.with_conflicts(evals, residues), residues


@query(f"WITH {ad.UNIVERSE_SQL} SELECT residue_index, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, plddt, is_center, aa FROM universe")
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.universe(spark, sf_dir).select("gene", "residue_index", *(F.round(c, 6).alias(c) for c in "xyz"), "plddt", "is_center", "aa")


@query(f"WITH {ad.COHORT_SQL} SELECT residue_index, class, plddt FROM cohort")
def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.cohort(ad.universe(spark, sf_dir)).select("gene", "residue_index", "class", "plddt")


@query(f"WITH {PARSED} SELECT record_id, transcript, hgvs_c, hgvs_p, ref_aa, position, alt_aa, is_missense, reason FROM parsed")
def hgvs_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.normalized(ad.raw_records(spark, sf_dir)).select("gene", "record_id", "transcript", "hgvs_c", "hgvs_p", "ref_aa", "position", "alt_aa", "is_missense", "reason")


def _sig_query(policy: str) -> str:
    return f"WITH {PARSED}, {_significance(policy)} SELECT record_id, class AS significance_class, exact_match, array_to_string(modifiers, ';') AS modifiers FROM sig"


def _sig(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    s = co.judged(co.normalized(ad.raw_records(spark, sf_dir)), policy)
    return s.select("gene", "record_id", "significance_class", "exact_match", F.array_join("modifiers", ";").alias("modifiers"))


@query(_sig_query("whole_field"))
def significance_whole_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sig(spark, sf_dir, "whole_field")


@query(_sig_query("component_wise"))
def significance_component_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sig(spark, sf_dir, "component_wise")


@query(f"WITH {PARSED}, {_significance('whole_field')}, w AS (SELECT k, class FROM sig), {_significance('component_wise').replace('s0 ', 't0 ').replace('s1 ', 't1 ').replace('s2 ', 't2 ').replace('sig AS', 'sig2 AS').replace('FROM s0', 'FROM t0').replace('FROM s1', 'FROM t1').replace('FROM s2', 'FROM t2')} SELECT w.class AS whole_field, s.class AS component_wise, count(*) AS n_records FROM w JOIN sig2 s USING (k) GROUP BY ALL")
def policy_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.policy_cost(ad.raw_records(spark, sf_dir))


@query(f"WITH {EVALS} SELECT record_id, star_level, residue_index, significance_class, on_mane, remapped, eligible, exclusion_reason, exclusion_detail FROM evals2")
def record_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evals(spark, sf_dir)[0].select("gene", "record_id", "star_level", "residue_index", "significance_class", "on_mane", "remapped", "eligible", "exclusion_reason", "exclusion_detail")


@query(f"WITH {EVALS} SELECT exclusion_reason, count(*) AS n_records FROM evals2 WHERE NOT eligible GROUP BY ALL")
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evals(spark, sf_dir)[0].where("not eligible").groupBy("gene", "exclusion_reason").agg(F.count(F.lit(1)).alias("n_records"))


@query(f"WITH {EVALS} SELECT residue_index, aa_ref, class, n_records_plp, n_records_blb, array_to_string(record_ids, ';') AS record_ids, max_star, class <> 'CONFLICT' AS eligible_primary FROM residues2")
def residue_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evals(spark, sf_dir)[1].select("gene", "residue_index", "aa_ref", "class", "n_records_plp", "n_records_blb", F.array_join("record_ids", ";").alias("record_ids"), "max_star", "eligible_primary")


@query(f"WITH {EVALS} SELECT residue_index, n_records_plp, n_records_blb FROM residues2 WHERE class = 'CONFLICT'")
def residue_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evals(spark, sf_dir)[1].where("class = 'CONFLICT'").select("gene", "residue_index", "n_records_plp", "n_records_blb")


@query(f"WITH {EVALS} SELECT count(*) FILTER (class <> 'CONFLICT') AS n, count(*) FILTER (class = 'PLP') AS n_plp, count(*) FILTER (class = 'BLB') AS n_blb, count(*) FILTER (class = 'CONFLICT') AS n_conflict, count(*) AS n_residues FROM residues2")
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.counts(_evals(spark, sf_dir)[1])


@query(f"""WITH {EVALS}, z AS (SELECT review_status, star_level, significance_class AS class, CASE WHEN eligible THEN 'eligible' ELSE 'excluded' END AS stratum FROM evals2)
SELECT review_status, star_level, CASE WHEN grouping(class) = 1 THEN 'ALL' ELSE class END AS class, CASE WHEN grouping(stratum) = 1 THEN 'ALL' ELSE stratum END AS stratum, count(*) AS n_records FROM z
GROUP BY GROUPING SETS ((review_status, star_level), (review_status, star_level, class), (review_status, star_level, stratum), (review_status, star_level, class, stratum))""")
def star_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.star_cube(_evals(spark, sf_dir)[0])


@query(f"WITH {EVALS} SELECT star_level, count(*) AS n_records FROM evals2 GROUP BY ALL")
def star_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evals(spark, sf_dir)[0].groupBy("gene", "star_level").agg(F.count(F.lit(1)).alias("n_records"))


@query(f"WITH {EVALS} SELECT count(*) AS n_all, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (NOT eligible) AS n_excluded, 0::BIGINT AS n_both, 0::BIGINT AS n_reasonless, count(*) FILTER (NOT eligible AND exclusion_reason IS NULL) = 0 AS conserved FROM evals2")
def conservation_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.conservation(_evals(spark, sf_dir)[0])


@query(f"WITH {ad.UNIVERSE_SQL}, b AS (SELECT CASE WHEN plddt < 50 THEN 'very_low' WHEN plddt < 70 THEN 'low' WHEN plddt < 90 THEN 'confident' ELSE 'very_high' END AS band, plddt FROM universe) SELECT band, count(*) AS n, round(count(*) / (SELECT count(*) FROM universe), 6) AS fraction, round(avg(plddt), 6) AS mean, round(quantile_cont(plddt, 0.5), 6) AS median, min(plddt) AS lowest, max(plddt) AS highest FROM b GROUP BY band")
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ad.universe(spark, sf_dir).withColumn("band", co.band(F.col("plddt"), [50, 70, 90], ["very_low", "low", "confident", "very_high"]))
    g = u.groupBy("gene", "band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("plddt"), 6).alias("mean"), F.round(F.percentile("plddt", 0.5), 6).alias("median"), F.min("plddt").alias("lowest"), F.max("plddt").alias("highest"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("gene"))
    return g.select("gene", "band", "n", F.round(share, 6).alias("fraction"), "mean", "median", "lowest", "highest")


@query(f"WITH {ad.UNIVERSE_SQL}, o AS (SELECT t, residue_index, residue_index - row_number() OVER (PARTITION BY t ORDER BY residue_index) AS g FROM universe, (SELECT unnest([50, 70]) AS t) WHERE plddt < t) SELECT t AS threshold, min(residue_index) AS start, max(residue_index) AS stop, count(*) AS length FROM o GROUP BY t, g")
def low_confidence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ad.universe(spark, sf_dir).withColumn("threshold", F.explode(F.array(F.lit(50), F.lit(70))))
    return co.runs(u, F.col("plddt") < F.col("threshold"), by=["gene", "threshold"])


@query(f"WITH {EVALS} SELECT record_id, residue_index, clinical_significance, significance_class, review_status, star_level, transcript, hgvs_p, exclusion_reason, exclusion_detail FROM evals2 WHERE NOT eligible")
def stratum_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.strata(*_evals(spark, sf_dir))["excluded"]


@query(f"""WITH {EVALS}, lv AS (SELECT residue_index, list(coalesce(star_level::VARCHAR, 'NA') ORDER BY significance_class <> 'PLP', record_id) AS lv FROM evals WHERE eligible GROUP BY 1)
SELECT residue_index, aa_ref, class, n_records_plp, n_records_blb, array_to_string(record_ids, ';') AS record_ids, array_to_string(lv, ';') AS star_levels, max_star, class <> 'CONFLICT' AS eligible_primary FROM residues2 JOIN lv USING (residue_index)""")
def stratum_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = co.evaluated(ad.raw_records(spark, sf_dir), ad.universe(spark, sf_dir))
    r = co.strata(evals, co.collapsed(evals))["residues"]
    return r.withColumns({c: F.array_join(c, ";") for c in ("record_ids", "star_levels")})


@query(f"WITH {EVALS}, ids AS (SELECT residue_index, string_agg(record_id, ';' ORDER BY record_id) FILTER (significance_class = 'PLP') AS ids_plp, string_agg(record_id, ';' ORDER BY record_id) FILTER (significance_class = 'BLB') AS ids_blb FROM evals WHERE eligible GROUP BY 1) SELECT residue_index, aa_ref, n_records_plp, n_records_blb, ids_plp, ids_blb, max_star, 'residue_class_conflict' AS exclusion_reason FROM residues2 JOIN ids USING (residue_index) WHERE class = 'CONFLICT'")
def stratum_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = co.evaluated(ad.raw_records(spark, sf_dir), ad.universe(spark, sf_dir))
    r = co.strata(evals, co.collapsed(evals))["conflicts"]
    return r.withColumns({c: F.array_join(c, ";") for c in ("ids_plp", "ids_blb")})


@query(f"WITH {EVALS}, p AS (SELECT count(DISTINCT residue_index) FILTER (significance_class = 'PLP') AS n_plp, count(DISTINCT residue_index) FILTER (significance_class = 'BLB') AS n_blb, coalesce(max(residue_index), 0) AS last_residue FROM evals) SELECT *, CASE WHEN last_residue = 0 THEN 'no_missense' WHEN last_residue > 2700 THEN 'too_long' WHEN n_plp > 0 AND n_blb > 0 THEN 'runnable' ELSE 'one_class' END AS category FROM p")
def gene_prescreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.prescreen(co.evaluated(ad.raw_records(spark, sf_dir), ad.universe(spark, sf_dir)))
