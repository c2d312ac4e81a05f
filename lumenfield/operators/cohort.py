"""From raw records to residues: eligibility, exclusion reasons, collapse, strata, and their proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as v

MANE = ["NM_900001.4", "ENST00000900001.2"]


def normalized(records: DataFrame) -> DataFrame:
    """Records with their parsed name and change; ids that repeat get -2, -3 and so on in order of arrival."""
    parts = v.with_protein_change(v.with_name_parts(records, "name"), "hgvs_p")
    again = F.row_number().over(Window.partitionBy("gene", "variation_id").orderBy("k"))
    ids = F.when(again == 1, F.col("variation_id")).otherwise(F.concat_ws("-", "variation_id", again.cast("string")))
    return parts.select("gene", "k", ids.alias("record_id"), "name", "clinical_significance", "review_status", "transcript", "hgvs_c", "hgvs_p", "ref_aa", "position", "alt_aa", "is_missense", "reason")


def _first_reason(*found: tuple[Column, Column]) -> Column:
    """struct(rank, reason, detail): of (reason or null, detail) the one of the highest precedence."""
    ranks = F.create_map(*(F.lit(x) for i, r in enumerate(v.REASONS) for x in (r, i)))
    each = [F.when(r.isNotNull(), F.struct(F.element_at(ranks, r).alias("rank"), r.alias("reason"), d.alias("detail"))) for r, d in found]
    return F.array_min(F.array(*each))


def judged(records: DataFrame, policy: str = "whole_field") -> DataFrame:
    """records with significance_class, exact_match, modifiers and sig_reason; each distinct field is judged once."""
    fields = records.select(F.col("clinical_significance").alias("_field")).distinct()
    fields = v.computed(fields, v.significance(F.col("_field"), policy), "significance_class", "exact_match", "modifiers", "sig_reason")
    return records.join(fields, F.col("clinical_significance").eqNullSafe(F.col("_field")), "left").drop("_field")


def evaluated(records: DataFrame, u: DataFrame, policy: str = "whole_field", mane: list[str] = MANE) -> DataFrame:
    """Every record with its judgement: class, residue, eligibility and one reason.

    A record must be a missense change, agree with the sequence in position and amino acid, and be P/LP or B/LB; a record on
    another transcript that agrees is remapped. Review stars decide nothing. Fields of few distinct values are judged once
    for each value.
    """
    sequence = u.select("gene", F.col("residue_index").alias("position"), F.col("aa").alias("aa_ref"))
    length = u.groupBy("gene").agg(F.max("residue_index").alias("length"))
    r = judged(normalized(records), policy)
    stars = records.select(F.col("review_status").alias("_status")).distinct().select("_status", v.star_level(F.col("_status")).alias("star_level"))
    r = r.join(stars, F.col("review_status").eqNullSafe(F.col("_status")), "left").drop("_status")
    r = r.join(sequence, ["gene", "position"], "left").join(length, "gene", "left")
    on_mane = v.transcript_matches(F.col("transcript"), mane)
    same = F.col("aa_ref") == F.col("ref_aa")
    mismatch = F.when(F.col("is_missense") & F.col("aa_ref").isNull(), "ref_aa_mismatch").when(F.col("is_missense") & ~same, F.when(on_mane, "ref_aa_mismatch").otherwise("non_canonical_transcript"))
    detail = F.when(F.col("aa_ref").isNull(), F.concat(F.lit("position_out_of_range:"), F.col("position").cast("string"), F.lit(">"), F.col("length").cast("string"))).otherwise(
        F.concat(F.lit("hgvs_ref="), F.col("ref_aa"), F.lit(";uniprot_ref="), F.col("aa_ref"), F.lit(";transcript="), F.coalesce("transcript", F.lit("NA")))
    )
    why = _first_reason(
        (F.when(~F.col("is_missense"), v.non_missense_reason(F.col("reason"))), F.col("reason")),
        (mismatch, detail),
        (F.col("sig_reason"), F.concat(F.lit("significance_class="), F.col("significance_class"))),
    )
    none = F.struct(F.lit(len(v.REASONS)).alias("rank"), F.lit(None).cast("string").alias("reason"), F.lit("NA").alias("detail"))
    return v.computed(r, F.coalesce(why, none), "rank", "exclusion_reason", "exclusion_detail").select(
        "gene", "record_id", "clinical_significance", "review_status", "star_level", "transcript", "hgvs_p", "ref_aa", "alt_aa", "aa_ref",
        F.when(F.col("is_missense"), F.col("position")).alias("residue_index"), "significance_class", "exact_match", on_mane.alias("on_mane"),
        (F.col("is_missense") & F.coalesce(same, F.lit(False)) & ~on_mane).alias("remapped"),
        F.col("exclusion_reason").isNull().alias("eligible"), "exclusion_reason", "exclusion_detail",
    )


def collapsed(evals: DataFrame) -> DataFrame:
    """A row per residue with eligible records; a residue with both classes is a conflict and not eligible."""
    g = evals.where("eligible").groupBy("gene", "residue_index", F.col("aa_ref")).agg(
        F.count_if(F.col("significance_class") == "PLP").alias("n_records_plp"),
        F.count_if(F.col("significance_class") == "BLB").alias("n_records_blb"),
        F.array_sort(F.collect_list("record_id")).alias("record_ids"),
        F.max("star_level").alias("max_star"),
    )
    kind = F.when((F.col("n_records_plp") > 0) & (F.col("n_records_blb") > 0), "CONFLICT").when(F.col("n_records_plp") > 0, "PLP").otherwise("BLB")
    return g.withColumn("class", kind).withColumn("eligible_primary", F.col("class") != "CONFLICT")


def with_conflicts(evals: DataFrame, residues: DataFrame) -> DataFrame:
    """The judgements after collapse: records of a conflicting residue are excluded for that reason."""
    bad = residues.where(~F.col("eligible_primary")).select("gene", "residue_index", F.lit(True).alias("_bad"))
    hit = F.col("eligible") & F.coalesce("_bad", F.lit(False))
    out = evals.join(bad, ["gene", "residue_index"], "left").withColumn("_hit", hit)
    return (
        out.withColumn("exclusion_reason", F.when(F.col("_hit"), "residue_class_conflict").otherwise(F.col("exclusion_reason")))
        .withColumn("exclusion_detail", F.when(F.col("_hit"), F.concat(F.lit("residue_index="), F.col("residue_index").cast("string"))).otherwise(F.col("exclusion_detail")))
        .withColumn("eligible", F.col("eligible") & ~F.col("_hit"))
        .drop("_bad", "_hit")
    )


def star_cube(evals: DataFrame) -> DataFrame:
    """Counts by review status and level, and by class and stratum with ALL margins."""
    e = evals.select("gene", F.col("review_status"), "star_level", F.col("significance_class").alias("class"), F.when(F.col("eligible"), "eligible").otherwise("excluded").alias("stratum"))
    base = ["gene", "review_status", "star_level"]
    cube = e.groupingSets([[*base, *more] for more in ([], ["class"], ["stratum"], ["class", "stratum"])], *base, "class", "stratum")
    out = cube.agg(F.count(F.lit(1)).alias("n_records"), F.grouping("class").alias("gc"), F.grouping("stratum").alias("gs"))
    return out.select(*base, F.when(F.col("gc") == 1, "ALL").otherwise(F.col("class")).alias("class"), F.when(F.col("gs") == 1, "ALL").otherwise(F.col("stratum")).alias("stratum"), "n_records")


def conservation(evals: DataFrame) -> DataFrame:
    """One row: all records are either eligible or excluded, never both, and every exclusion has a reason."""
    ids = evals.groupBy("gene", "record_id").agg(F.max("eligible").alias("e"), F.max(~F.col("eligible")).alias("x"), F.max(~F.col("eligible") & F.col("exclusion_reason").isNull()).alias("bare"))
    out = ids.groupBy("gene").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("e").alias("n_eligible"), F.count_if("x").alias("n_excluded"), F.count_if(F.col("e") & F.col("x")).alias("n_both"), F.count_if("bare").alias("n_reasonless"))
    return out.withColumn("conserved", (F.col("n_both") == 0) & (F.col("n_reasonless") == 0) & (F.col("n_eligible") + F.col("n_excluded") == F.col("n_all")))


def counts(residues: DataFrame) -> DataFrame:
    ok = F.col("eligible_primary")
    return residues.groupBy("gene").agg(F.count_if(ok).alias("n"), F.count_if(ok & (F.col("class") == "PLP")).alias("n_plp"), F.count_if(ok & (F.col("class") == "BLB")).alias("n_blb"), F.count_if(F.col("class") == "CONFLICT").alias("n_conflict"), F.count(F.lit(1)).alias("n_residues"))


def assert_viable(residues: DataFrame) -> None:
    """Both classes present and two residues at least, in every gene."""
    bad = counts(residues).where("n_plp = 0 or n_blb = 0 or n < 2").first()
    if bad or residues.isEmpty():
        raise ValueError(f"no viable cohort: {bad and bad.asDict()}")


def policy_cost(records: DataFrame) -> DataFrame:
    """How many records each pair of readings (whole field, component-wise) concerns."""
    n = records.groupBy("gene", "clinical_significance").agg(F.count(F.lit(1)).alias("n"))
    kind = lambda policy: v.significance(F.col("clinical_significance"), policy)["class"].alias(policy)
    return n.select("gene", "n", kind("whole_field"), kind("component_wise")).groupBy("gene", "whole_field", "component_wise").agg(F.sum("n").alias("n_records"))


def runs(df: DataFrame, flag: Column, order: str = "residue_index", by: list[str] | None = None) -> DataFrame:
    """Maximal runs of consecutive positions where flag holds: start, stop, length."""
    by = by or ["gene"]
    on = df.where(flag).withColumn("_island", F.col(order) - F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return on.groupBy(*by, "_island").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("length")).drop("_island")


def band(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Half-open bands: a value on an edge is of the band above."""
    out = F.when(value < edges[0], labels[0])
    for e, name in zip(edges[1:], labels[1:]):
        out = out.when(value < e, name)
    return out.otherwise(labels[-1])


def strata(evals: DataFrame, residues: DataFrame) -> dict[str, DataFrame]:
    """The tables that a run hands out: all records, residues, excluded records, and conflicts, each under its frozen columns."""
    record = ["gene", "record_id", "residue_index", "clinical_significance", "significance_class", "review_status", "star_level", "transcript", "hgvs_p", "exclusion_reason", "exclusion_detail"]
    ok = evals.where("eligible").select("gene", "residue_index", "record_id", "star_level", "significance_class")
    star = F.coalesce(F.col("star_level").cast("string"), F.lit("NA"))
    order = F.struct((F.col("significance_class") != "PLP").alias("late"), "record_id", star.alias("star"))
    levels = ok.groupBy("gene", "residue_index").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["star"]).alias("star_levels"))
    ids = lambda kind: F.array_sort(F.collect_list(F.when(F.col("significance_class") == kind, F.col("record_id"))))
    both = ok.groupBy("gene", "residue_index").agg(ids("PLP").alias("ids_plp"), ids("BLB").alias("ids_blb"))
    conflict = residues.where("class = 'CONFLICT'").join(both, ["gene", "residue_index"])
    return {
        "records": evals.select("gene", "record_id", "clinical_significance", "significance_class", "exact_match", "review_status", "star_level", "transcript", "on_mane", "remapped", "hgvs_p", "ref_aa", "alt_aa", "residue_index", "aa_ref", "eligible", "exclusion_reason", "exclusion_detail"),
        "residues": residues.join(levels, ["gene", "residue_index"]).select("gene", "residue_index", "aa_ref", "class", "n_records_plp", "n_records_blb", "record_ids", "star_levels", "max_star", "eligible_primary"),
        "excluded": evals.where("not eligible").select(record),
        "conflicts": conflict.select("gene", "residue_index", "aa_ref", "n_records_plp", "n_records_blb", "ids_plp", "ids_blb", "max_star", F.lit("residue_class_conflict").alias("exclusion_reason")),
    }


def prescreen(evals: DataFrame, longest: int = 2700) -> DataFrame:
    """Per gene: distinct residues with a P/LP and with a B/LB missense record, the last residue named, and whether the gene can be run."""
    at = lambda kind: F.count_distinct(F.when(F.col("significance_class") == kind, F.col("residue_index")))
    g = evals.groupBy("gene").agg(at("PLP").alias("n_plp"), at("BLB").alias("n_blb"), F.coalesce(F.max("residue_index"), F.lit(0)).alias("last_residue"))
    kind = F.when(F.col("last_residue") == 0, "no_missense").when(F.col("last_residue") > longest, "too_long").when((F.col("n_plp") > 0) & (F.col("n_blb") > 0), "runnable").otherwise("one_class")
    return g.withColumn("category", kind)
