"""Many runs: the newest of each gene, and what it says about the gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_by_gene(handoffs: DataFrame, value: str = "value") -> DataFrame:
    """(gene, run_id, state, radius, warnings) from handoffs as JSON text, whatever else they hold: of each gene the newest run that names it. Run ids begin with
    their time, so the greatest is the newest. A text that is no JSON object, or has no run_id, counts for nothing; a run without radii names no gene."""
    v = handoffs.select(F.try_parse_json(F.col(value)).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    runs = v.select(get("$.run_id", "string").alias("run_id"), get("$.state", "string").alias("state"), get("$.facts.radius", "map<string, double>").alias("radius"), get("$.warnings", "array<string>").alias("warnings"))
    each = runs.where("run_id IS NOT NULL").select("run_id", "state", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.explode("radius").alias("gene", "radius"))
    best = each.groupBy("gene").agg(F.max_by(F.struct("run_id", "state", "radius", "warnings"), F.struct("run_id", "radius")).alias("m"))
    return best.select("gene", "m.*")


def classified(rows: DataFrame) -> DataFrame:
    """rows with regime, tier and caveat. Columns: state, stop_reason, n_p (null where inputs couldn't be assembled), n_centers, footprint_radius,
    coverage, fold_enrichment, jaccard_median, binding_is_outlier; any of them may be null.

    Eight regimes, the first that holds: input_limited (no n_p), cannot_be_asked (underpowered), input_limited (no centres and a
    cohort that can't be analysed), no_spatial_concentration (no centres), refused_degenerate (no footprint for want of a volume),
    diffuse_no_localised_region (no footprint), works_with_caveat (tier D) and works. The tier counts four tests: enrichment of 1.5,
    median Jaccard of 0.9, no outlier binding the radius, coverage under 0.3.
    """
    fe, j, cov, out = F.col("fold_enrichment"), F.col("jaccard_median"), F.col("coverage"), F.coalesce("binding_is_outlier", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    why = F.coalesce("stop_reason", F.lit(""))
    none = F.coalesce("n_centers", F.lit(0)) == 0
    regimes: list[tuple[str, Column, Column]] = [
        ("input_limited", F.col("n_p").isNull(), F.concat(F.lit("no usable inputs: "), F.substring(why, 1, 90))),
        ("cannot_be_asked", yes(F.col("state") == "UNDERPOWERED"), F.lit("no attainable p clears the threshold, whatever the number of draws")),
        ("input_limited", none & yes(F.col("state") == "COMPLETED_NEGATIVE") & why.startswith("INSUFF"), F.lit("one class of the cohort is empty")),
        ("no_spatial_concentration", none, F.lit("the test could have rejected and did not")),
        ("refused_degenerate", F.col("footprint_radius").isNull() & (why == "NO_ADMISSIBLE_FOOTPRINT"), F.lit("the centres are the evidence themselves; a footprint of radius 0 has no volume")),
        ("diffuse_no_localised_region", F.col("footprint_radius").isNull(), F.lit("the region covers most of the structure; the centres stand")),
    ]
    score = sum(yes(t).cast("int") for t in (fe >= 1.5, j >= 0.9, ~out, cov < 0.3))
    tier = F.element_at(F.array(*(F.lit(t) for t in "DDCBA")), score + 1)
    text = lambda c, digits: F.format_string(f"%.{digits}f", c)
    notes = F.array_compact(F.array(
        F.when(fe < 1.05, "no enrichment over the labelled background").when(fe < 1.5, F.concat(F.lit("weak enrichment ("), text(fe, 2), F.lit(")"))),
        F.when(j < 0.7, F.concat(F.lit("fragile under loss of centres (Jaccard "), text(j, 3), F.lit(")"))).when(j < 0.9, F.concat(F.lit("moderate stability (Jaccard "), text(j, 3), F.lit(")"))),
        F.when(out, "the radius rests on one outlying residue"), F.when(cov >= 0.3, F.concat(F.lit("the footprint covers "), text(cov, 3), F.lit(" of the structure"))),
    ))
    regime = caveat = None
    for name, holds, said in regimes:
        regime = F.when(holds, name) if regime is None else regime.when(holds, name)
        caveat = F.when(holds, said) if caveat is None else caveat.when(holds, said)
    works = F.when(tier == "D", "works_with_caveat").otherwise("works")
    found = rows.withColumn("regime", regime.otherwise(works)).withColumn("caveat", caveat.otherwise(F.when(F.size(notes) > 0, F.array_join(notes, "; ")).otherwise("meets all four criteria")))
    return found.withColumn("tier", F.when(F.col("regime").startswith("works"), tier).otherwise(""))
