"""Radius scans, regions of significant centres, and the three residue objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st
from . import nulls as nu
from . import pairs as pr
from . import spatial as sp


def scan(u: DataFrame, labelled: DataFrame, radii: list[float], q: float = 0.05) -> DataFrame:
    """The tested centres of all radii, as significant_centers() has them, with a column radius: one comparison at the largest
    radius serves them all."""
    occupied = sp.occupancies(u, labelled, [float(r) for r in radii])
    return st.benjamini_hochberg(nu.with_tails(u, labelled, occupied.where("n_l >= 1")), q=q, by=["gene", "radius"])


def radius_rows(u: DataFrame, labelled: DataFrame, tested: DataFrame, radii: list[float]) -> DataFrame:
    """Per radius: tested and significant centres, coverage, fold enrichment inside, and whether it is admissible."""
    total = u.groupBy("gene").agg(F.count(F.lit(1)).alias("m_all"))
    lab = labelled.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == "PLP").alias("n_plp"))
    rows = tested.groupBy("gene", "radius").agg(F.count(F.lit(1)).alias("m"), F.count_if("significant").alias("n_sig"), F.min("p").alias("p_min"), F.max(F.when(F.col("significant"), F.col("n_l"))).alias("absorbed"))
    inside = covered_counts(u, labelled, tested.where("significant"), radii)
    out = rows.join(inside, ["gene", "radius"], "left").fillna(0, ["n_cov", "l_in", "p_in"]).join(total, "gene").join(lab, "gene")
    enrichment = F.when(F.col("n_sig") == 0, 0.0).when(F.col("l_in") > 0, (F.col("p_in") / F.col("l_in")) / (F.col("n_plp") / F.col("n")))
    out = out.withColumn("fe_defined", F.col("l_in") > 0)
    return out.select("gene", "radius", "m", "n_sig", "p_min", (F.col("n_cov") / F.col("m_all")).alias("coverage"), F.coalesce(enrichment, F.lit(0.0)).alias("fold_enrichment"), F.coalesce(F.col("absorbed") / F.col("n"), F.lit(0.0)).alias("absorption"), enrichment.isNotNull().alias("admissible"))


def covered_counts(u: DataFrame, labelled: DataFrame, significant: DataFrame, radii: list[float]) -> DataFrame:
    """(gene, radius, n_cov, l_in, p_in): positions within a radius of a centre that is significant at it (gene, radius, residue_index), and the labelled and
    P/LP ones among them; a radius without any has no row."""
    code = labelled.select("gene", "residue_index", F.when(F.col("class") == "PLP", 2).when(F.col("class").isNotNull(), 1).alias("code"))
    positions = u.select(*sp.POINT).join(code, ["gene", "residue_index"], "left").fillna(0, ["code"])
    flags = significant.groupBy("gene", "residue_index").agg(*(F.max(F.col("radius") == float(r)).alias(f"s{k}") for k, r in enumerate(radii)))
    centers = u.select(*sp.POINT).join(flags.hint("merge"), ["gene", "residue_index"])

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        most, own = [pr.most_squared(r) for r in radii], [b[f"s{k}"].to_numpy(bool) for k in range(len(radii))]
        hit, code = np.zeros((len(radii), len(a)), bool), a["code"].to_numpy()
        for rows, cols, d2 in pr.blocks(pr.xyz(a), pr.xyz(b)):
            for k, m in enumerate(most):
                hit[k, rows] |= ((d2 <= m) & own[k][cols]).any(axis=1)
        n = lambda least: (hit & (code >= least)).sum(axis=1)
        return pd.DataFrame({"gene": a["gene"].iat[0], "radius": np.array(radii, float), "n_cov": n(0), "l_in": n(1), "p_in": n(2)})

    parts = pr.near_groups(positions, centers, max(radii), kernel, "gene string, radius double, n_cov long, l_in long, p_in long")
    return parts.where("n_cov > 0").groupBy("gene", "radius").agg(*(F.sum(c).alias(c) for c in ("n_cov", "l_in", "p_in")))


#: What a radius is chosen by; larger is better.
OBJECTIVES = ["loo_mcc", "perm_evidence_zg", "fold_enrichment", "neighbor_stability"]


def objectives(u: DataFrame, labelled: DataFrame, tested: DataFrame, radii: list[float], step: float) -> DataFrame:
    """radius_rows() with the four OBJECTIVES: leave-one-out MCC, evidence Zg, fold enrichment, and the stability of the
    significant set against the neighbouring radii. A radius without significant centres scores 0 in enrichment and stays admissible."""
    rows = radius_rows(u, labelled, tested, radii)
    loo = nu.confusion(nu.leave_one_out(labelled, radii), ["gene", "radius"]).select("gene", "radius", F.col("mcc").alias("loo_mcc"))
    zg = nu.moments(nu.label_weights(u, labelled, tested, radii), labelled).select("gene", "radius", F.col("zg").alias("perm_evidence_zg"))
    stable = neighbour_jaccard(tested, step).select("gene", "radius", F.col("stability").alias("neighbor_stability"))
    out = rows.join(loo, ["gene", "radius"]).join(zg, ["gene", "radius"]).join(stable, ["gene", "radius"], "left")
    return out.fillna(0.0, ["neighbor_stability"])


def neighbour_jaccard(tested: DataFrame, step: float) -> DataFrame:
    """Per radius: mean Jaccard of its significant set with those at radius - step and radius + step; empty sets give 0."""
    key = F.round(F.col("radius"), 6)
    sig = tested.where("significant").select("gene", key.alias("radius"), "residue_index")
    grid = tested.select("gene", key.alias("radius")).distinct()
    n = grid.join(sig.groupBy("gene", "radius").agg(F.count(F.lit(1)).alias("n")), ["gene", "radius"], "left").fillna(0, ["n"])
    moved = [n.select("gene", "radius", "n", F.round(F.col("radius") + s, 6).alias("r2")) for s in (-step, step)]
    near = moved[0].union(moved[1]).join(n.select("gene", F.col("radius").alias("r2"), F.col("n").alias("n2")), ["gene", "r2"])
    both = sig.select("gene", F.col("radius").alias("r2"), "residue_index").join(sig, ["gene", "residue_index"]).groupBy("gene", "radius", "r2").agg(F.count(F.lit(1)).alias("both"))
    j = near.join(both, ["gene", "radius", "r2"], "left").fillna(0, ["both"])
    return j.groupBy("gene", "radius").agg(F.avg(st.jaccard(F.col("both"), F.col("n") + F.col("n2") - F.col("both"))).alias("stability"))


def _label(pdf: pd.DataFrame, reach: float) -> pd.DataFrame:
    """Components of one gene's centres under d <= reach, numbered by their first residue. A gene's centres are a few hundred."""
    pdf = pdf.sort_values("residue_index").reset_index(drop=True)
    p = pdf[["x", "y", "z"]].to_numpy()
    label = np.zeros(len(pdf), int)
    n = 0
    for i in range(len(pdf)):
        if label[i]:
            continue
        n += 1
        todo = [i]
        label[i] = n
        while todo:
            near = np.flatnonzero((np.sqrt(((p - p[todo.pop()]) ** 2).sum(axis=1)) <= reach) & (label == 0))
            label[near] = n
            todo += near.tolist()
    return pdf[["gene", "residue_index"]].assign(region=label)


def regions(centers: DataFrame, radius: float | None = None) -> DataFrame:
    """(gene, residue_index, region) of centres that chain within twice the radius (each gene's own, from a column, if none is given)."""
    schema = f"gene string, residue_index {centers.schema['residue_index'].dataType.simpleString()}, region int"
    own = centers.select("gene", "residue_index", "x", "y", "z", (F.lit(float(radius)) if radius is not None else F.col("radius")).alias("radius"))
    return own.groupBy("gene").applyInPandas(lambda pdf: _label(pdf, 2 * pdf["radius"].iloc[0]), schema)


def objects(u: DataFrame, labelled: DataFrame, centers: DataFrame, region: DataFrame, radius: float | DataFrame) -> DataFrame:
    """Covered residues with their sorted regions, number of covering centres, class, and whether they are centres."""
    near = sp.within(centers, u, radius).join(region.select("gene", F.col("residue_index").alias("center"), "region"), ["gene", "center"])
    g = near.groupBy("gene", F.col("point").alias("residue_index")).agg(F.array_sort(F.collect_set("region")).alias("regions"), F.count(F.lit(1)).alias("n_covering"))
    c = centers.select("gene", "residue_index", F.lit(True).alias("is_center"))
    out = g.join(labelled.select("gene", "residue_index", "class"), ["gene", "residue_index"], "left").join(c, ["gene", "residue_index"], "left")
    return out.fillna(False, ["is_center"])


def nesting(objects_: DataFrame, centers: DataFrame, classified: DataFrame) -> DataFrame:
    """Per gene: centres that aren't among the covered residues, classified residues that aren't, and whether the classified ones are
    exactly those that objects() marks so; all is well where both counts are 0 and the last is true."""
    c = objects_.select("gene", "residue_index", F.col("class").isNotNull().alias("flag"), F.lit(True).alias("covered"))
    one = centers.select("gene", "residue_index", F.lit(True).alias("is_c"))
    two = classified.select("gene", "residue_index", F.lit(True).alias("is_v"))
    a = c.join(one, ["gene", "residue_index"], "full_outer").join(two, ["gene", "residue_index"], "full_outer")
    no = lambda x: F.coalesce(F.col(x), F.lit(False))
    g = a.groupBy("gene").agg(F.count_if(no("is_c") & ~no("covered")).alias("centers_outside"), F.count_if(no("is_v") & ~no("covered")).alias("classified_outside"), F.every(no("is_v") == no("flag")).alias("flags_agree"))
    return g.withColumn("nested", (F.col("centers_outside") == 0) & (F.col("classified_outside") == 0) & F.col("flags_agree"))
