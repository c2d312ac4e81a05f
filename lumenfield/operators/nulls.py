"""Null models: keyed draws, positional and label nulls, exact tails, certificates, leave-one-out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from . import pairs as pr
from .spatial import POINT, occupancies, occupancy, range_join


def draws(u: DataFrame, sizes: DataFrame, seed: str, b: int) -> DataFrame:
    """(gene, b, residue_index): b subsets of size n_draw (from sizes) without replacement. Positions are ranked by an MD5 of seed,
    number and position, so a draw doesn't depend on partitioning."""
    each = u.select("gene", "residue_index", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("b").cast("string"), F.col("residue_index").cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy("gene", "b").orderBy("key", "residue_index"))
    ranked = each.withColumn("key", key).withColumn("rank", rank)
    return ranked.join(F.broadcast(sizes), "gene").where("rank <= n_draw").select("gene", "b", "residue_index")


def positional_null(u: DataFrame, labelled: DataFrame, radius: float, seed: str, b: int) -> DataFrame:
    """Per centre: observed P/LP, null mean and sd, and add-one empirical p over b draws; draws that leave a sphere empty
    count as zeros without having rows."""
    n = labelled.where("class = 'PLP'").groupBy("gene").agg(F.count(F.lit(1)).alias("n_draw"))
    obs = occupancy(u, labelled, radius)
    own = draws(u, n, seed, b).groupBy("gene", "residue_index").agg(F.collect_list("b").alias("draws"))
    points = u.select(*POINT).join(own.hint("merge"), ["gene", "residue_index"])

    def kernel(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        at, times, most = pr.xyz(q), q["draws"].to_numpy(), pr.most_squared(radius)
        n_b, columns = np.zeros((len(c), b), np.float32), None  # whole numbers, exact up to 2^24
        for rows, cols, d2 in pr.blocks(pr.xyz(c), at):
            if cols != columns:
                columns, took = cols, np.zeros((cols.stop - cols.start, b), np.float32)
                took[np.repeat(np.arange(len(took)), [len(x) for x in times[cols]]), np.concatenate(times[cols]) - 1] = 1
            n_b[rows] += (d2 <= most).astype(np.float32) @ took
        n_b = n_b.astype(np.int64)
        return pd.DataFrame({"gene": c["gene"], "residue_index": c["residue_index"], "s1": n_b.sum(axis=1), "s2": (n_b * n_b).sum(axis=1), "ge": ((n_b > 0) & (n_b >= c["n_p"].to_numpy()[:, None])).sum(axis=1)})

    centers = u.select(*POINT).join(obs.select("gene", "residue_index", "n_p"), ["gene", "residue_index"])
    agg = pr.near_groups(centers, points, radius, kernel, f"{pr.typed(u, 'gene', 'residue_index')}, s1 long, s2 long, ge long")
    out = obs.join(agg, ["gene", "residue_index"], "left").fillna(0, ["s1", "s2", "ge"])
    ge = F.when(F.col("n_p") == 0, F.lit(b)).otherwise(F.col("ge"))
    mean = F.col("s1") / b
    var = F.greatest(F.lit(0.0), F.col("s2") / b - mean * mean) * b / (b - 1)
    return out.select("gene", "residue_index", "n_u", "n_l", "n_p", mean.alias("null_mean"), F.sqrt(var).alias("null_sd"), ((ge + 1) / (b + 1)).alias("p_emp"), (F.col("n_l").cast("boolean") & (var > 0)).alias("in_family"))


def label_null(u: DataFrame, labelled: DataFrame, radius: float, seed: str, b: int) -> DataFrame:
    """Per gene: T = sum over centres of n_p / n_l, its mean and sd over b permutations of the labels, and Z (0 where the sd is at most 1e-12 max(1, |T|))."""
    n = labelled.groupBy("gene").agg(F.count_if(F.col("class") == "PLP").alias("n_draw"))
    near = range_join(u, labelled, radius).select("gene", "center", F.col("point").alias("residue_index"))
    n_l = near.groupBy("gene", "center").agg(F.count(F.lit(1)).alias("n_l"))
    weight = near.join(n_l, ["gene", "center"]).groupBy("gene", "residue_index").agg(F.sum(1.0 / F.col("n_l")).alias("w"))
    w = labelled.select("gene", "residue_index", "class").join(weight, ["gene", "residue_index"])
    obs = w.where("class = 'PLP'").groupBy("gene").agg(F.sum("w").alias("t_obs"))
    null = draws(labelled, n, seed, b).join(w, ["gene", "residue_index"]).groupBy("gene", "b").agg(F.sum("w").alias("t"))
    m = null.groupBy("gene").agg(F.avg("t").alias("t_mean"), F.stddev_samp("t").alias("t_sd"))
    z = F.when(F.col("t_sd") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("t_obs")), 0.0).otherwise((F.col("t_obs") - F.col("t_mean")) / F.col("t_sd"))
    return obs.join(m, "gene").withColumn("z", z)


def label_moments(near: DataFrame, labelled: DataFrame) -> DataFrame:
    """(gene, radius, t_obs, t_mean, t_sd, zg): label_null() with the exact mean and sd over all permutations, for every radius.

    T is the sum of the P/LP residues' weights, and a permutation draws them without replacement, so both moments follow
    from the weights' mean and variance. near: (gene, radius, center, point) of labelled points.
    """
    n_l = near.groupBy("gene", "radius", "center").agg(F.count(F.lit(1)).alias("n_l"))
    w = near.join(n_l, ["gene", "radius", "center"]).groupBy("gene", "radius", F.col("point").alias("residue_index")).agg(F.sum(1.0 / F.col("n_l")).alias("w"))
    return moments(w, labelled)


def label_weights(u: DataFrame, labelled: DataFrame, occupied: DataFrame, radii: list[float]) -> DataFrame:
    """(gene, radius, residue_index, w) of the labelled residues, as label_moments() sums them: 1 / n_l of every centre within radius. occupied: rows of
    (gene, radius, residue_index, n_l) of the centres with a labelled residue in reach."""
    share = [F.coalesce(F.max(F.when(F.col("radius") == float(r), 1.0 / F.col("n_l"))), F.lit(0.0)).alias(f"w{k}") for k, r in enumerate(radii)]
    points = u.select(*POINT).join(occupied.groupBy("gene", "residue_index").agg(*share).hint("merge"), ["gene", "residue_index"])

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        most, own = [pr.most_squared(r) for r in radii], [b[f"w{k}"].to_numpy() for k in range(len(radii))]
        w = np.zeros((len(radii), len(a)))
        for rows, cols, d2 in pr.blocks(pr.xyz(a), pr.xyz(b)):
            for k, m in enumerate(most):
                w[k, rows] += (d2 <= m) @ own[k][cols]
        rows = {c: np.tile(a[c].to_numpy(), len(radii)) for c in ("gene", "residue_index")}
        return pd.DataFrame(rows | {"radius": np.repeat(np.array(radii, float), len(a)), "w": w.ravel()}).query("w > 0")

    return pr.near_groups(labelled.select(*POINT), points, max(radii), kernel, f"{pr.typed(labelled, 'gene', 'residue_index')}, radius double, w double")


def moments(w: DataFrame, labelled: DataFrame) -> DataFrame:
    """label_moments() of given weights (gene, radius, residue_index, w)."""
    is_p = F.col("class") == "PLP"
    g = w.join(labelled.select("gene", "residue_index", "class"), ["gene", "residue_index"]).groupBy("gene", "radius")
    m = g.agg(F.sum(F.when(is_p, F.col("w"))).alias("t_obs"), F.count_if(is_p).alias("np"), F.count(F.lit(1)).alias("nn"), F.avg("w").alias("mu"), F.var_pop("w").alias("v"))
    sd = F.sqrt(F.col("np") * (F.col("nn") - F.col("np")) / F.greatest(F.col("nn") - 1, F.lit(1)) * F.col("v"))
    m = m.select("gene", "radius", F.coalesce("t_obs", F.lit(0.0)).alias("t_obs"), (F.col("np") * F.col("mu")).alias("t_mean"), sd.alias("t_sd"))
    flat = F.col("t_sd") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("t_obs"))
    return m.withColumn("zg", F.when(flat, 0.0).otherwise((F.col("t_obs") - F.col("t_mean")) / F.col("t_sd")))


def _tails(pdf: pd.DataFrame) -> pd.DataFrame:
    """P(X >= n_p) and the least such probability of n_u draws, for rows of one gene. Logarithms are summed in extended precision: those of the
    factorials of a large gene have few digits behind the point left."""
    m_all, good = int(pdf["m_all"].iat[0]), int(pdf["m_good"].iat[0])
    lf = np.cumsum(np.log(np.maximum(np.arange(m_all + 1), 1)), dtype=np.longdouble)
    comb = lambda a, b: lf[a] - lf[b] - lf[a - b]
    out = []
    for n, g in pdf.groupby("n_u"):
        low, high = max(0, int(n) + good - m_all), min(good, int(n))
        n_p = g["n_p"].to_numpy()
        if low > high:  # more good ones than there are
            out.append(g.assign(p=np.where(n_p <= low, 1.0, 0.0), p_floor=1.0))
            continue
        k = np.arange(low, high + 1)
        each = np.exp((comb(good, k) + comb(m_all - good, n - k) - comb(m_all, n)).astype(float))
        tail = np.minimum(1.0, np.cumsum(each[::-1])[::-1])
        tail[0] = 1.0
        p = np.where(n_p > high, 0.0, tail[np.clip(n_p - low, 0, high - low)])
        out.append(g.assign(p=p, p_floor=tail[-1]))
    return pd.concat(out).drop(columns="_some")


def exact_tails(u: DataFrame, labelled: DataFrame, radius: float) -> DataFrame:
    """occupancy() with the gene's totals, the expected n_p, the exact tail p and the smallest p that the centre can reach."""
    return with_tails(u, labelled, occupancy(u, labelled, radius))


def with_tails(u: DataFrame, labelled: DataFrame, occupied: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """Rows of n_u and n_p (of any radius) with m_all, m_good, expected, p and p_floor; by: gene and what else parts both tables."""
    size = u.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("m_all"))
    good = labelled.groupBy(*by).agg(F.count_if(F.col("class") == "PLP").cast("int").alias("m_good"))
    o = occupied.join(size, list(by)).join(good, list(by))
    # tails are made once for each distinct (n_u, n_p), those of an n_u from one sum
    key = ["gene", "n_u", "n_p", "m_all", "m_good"]
    some = o.select(*key, F.floor(F.col("n_u") / 64).alias("_some")).distinct()
    group = ["gene", "m_all", "m_good", "_some"]
    schema = f"{pr.typed(o, *key)}, p double, p_floor double"
    tails = some.repartition(pr.tasks(u), *group).groupBy(*group).applyInPandas(_tails, schema)
    return o.join(tails.hint("merge"), key).withColumn("expected", F.col("m_good") * F.col("n_u") / F.col("m_all"))


def significant_centers(u: DataFrame, labelled: DataFrame, radius: float, q: float = 0.05) -> DataFrame:
    """Centres with a labelled position in reach, tested by the exact tail, with Benjamini-Hochberg over the gene."""
    return st.benjamini_hochberg(exact_tails(u, labelled, radius).where("n_l >= 1"), q=q)


def leave_one_out(labelled: DataFrame, radius: float | list[float], kappa: float = 2.0, tie: float = 1e-12) -> DataFrame:
    """Per labelled residue (and radius, if there are several): labelled neighbours, P/LP among them, the smoothed vote, and
    the prediction. Without neighbours, or on a tie, it is BLB."""
    radii = radius if isinstance(radius, list) else [radius]
    y, each = (F.col("class") == "PLP").cast("int"), F.explode(F.array(*(F.lit(float(r)) for r in radii))).alias("radius")
    n = labelled.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos"))
    found = occupancies(labelled, labelled, [float(r) for r in radii]).join(labelled.select("gene", "residue_index", y.alias("y1")), ["gene", "residue_index"])
    votes = found.select("gene", "radius", "residue_index", (F.col("n_l") - 1).alias("n_l"), (F.col("n_p") - F.col("y1")).alias("n_p"))  # without itself
    s = labelled.select("gene", "residue_index", "class", y.alias("y"), each).join(votes, ["gene", "radius", "residue_index"], "left").fillna(0, ["n_l", "n_p"]).join(n, "gene")
    prior = (F.col("n_pos") - F.col("y")) / (F.col("n") - 1)
    vote = (F.col("n_p") + kappa * prior) / (F.col("n_l") + kappa)
    delta = vote - prior
    return s.withColumn("vote", vote).withColumn("predicted", F.when((F.col("n_l") > 0) & (delta > 0) & (F.abs(delta) > tie), "PLP").otherwise("BLB"))


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and metrics of predicted against class."""
    hit = lambda p, c: F.count_if((F.col("predicted") == p) & (F.col("class") == c))
    c = df.groupBy(*by).agg(hit("PLP", "PLP").alias("tp"), hit("PLP", "BLB").alias("fp"), hit("BLB", "BLB").alias("tn"), hit("BLB", "PLP").alias("fn"))
    return c.select("*", *(m.alias(k) for k, m in st.rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")).items()))


def certificate(floors: DataFrame, q: float, b: int | None = None) -> DataFrame:
    """Per gene: can any centre be rejected? The best floor (not below 1 / (b + 1) when p is empirical) against q / m; m = 0
    fails: a gene with rows but without tested centres (n_l = 0 in all of them) has such a row."""
    floors = floors.withColumn("_in", F.col("n_l") > 0) if "n_l" in floors.columns else floors.withColumn("_in", F.lit(True))
    low = F.min(F.when(F.col("_in"), F.col("p_floor")))
    agg = floors.groupBy("gene").agg(F.count_if("_in").alias("m"), low.alias("p_best"))
    p = F.greatest(F.col("p_best"), F.lit(1.0 / (b + 1))) if b else F.col("p_best")
    c1 = F.when(F.col("m") > 0, F.lit(q) / F.col("m"))
    return agg.withColumn("p_floor", p).withColumn("c1", c1).withColumn("ratio", p / c1).withColumn("passes", F.coalesce(p <= c1, F.lit(False))).withColumn("b_required", (F.ceil(1 / c1) - 1).cast("long"))


def sparse_evidence(loo: DataFrame, few: int = 3) -> DataFrame:
    """(gene, scope, ...): how thin the evidence of leave_one_out() is, over all residues and by true and predicted class: residues without
    neighbours, with fewer than ``few``, with a tied vote, their shares, and the distribution of neighbours. Nothing is left out for it."""
    scopes = (("overall", F.lit(True)), ("true_PLP", F.col("class") == "PLP"), ("true_BLB", F.col("class") == "BLB"), ("pred_PLP", F.col("predicted") == "PLP"), ("pred_BLB", F.col("predicted") == "BLB"))
    each = loo.select("gene", "n_l", (F.col("n_l") == 0).alias("zero"), (F.col("n_l") < few).alias("sparse"), ((F.col("n_l") > 0) & (F.abs(F.col("vote") - (F.col("n_pos") - F.col("y")) / (F.col("n") - 1)) <= 1e-12)).alias("tie"), F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in scopes)), lambda x: x.isNotNull())).alias("scope"))
    share = lambda c: F.avg(F.col(c).cast("int"))
    return each.groupBy("gene", "scope").agg(F.count(F.lit(1)).alias("n_residues"), *(x for c in ("zero", "sparse", "tie") for x in (F.count_if(c).alias(f"n_{c}"), share(c).alias(f"share_{c}"))), F.min("n_l").alias("lowest"), *(F.percentile("n_l", q).alias(k) for k, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))), F.max("n_l").alias("highest"), F.avg("n_l").alias("mean"))


def resolution(empirical: DataFrame, b: int, q: float = 0.05, safety: int = 10, target: int = 1, ladder: tuple[int, ...] = (10_000, 100_000, 1_000_000, 10_000_000), most: int = 10_000_000) -> DataFrame:
    """Per gene, of p_emp in the test family: whether b draws are too few to tell (C0: the least p is over q; C1: it is over q / m; C2: fewer
    centres than needed are at the least p; C3: one at the least p isn't rejected), and the b that would do. Only reported: it changes neither b nor any test."""
    fam = st.benjamini_hochberg(empirical.where("in_family"), p="p_emp", q=q)
    least = 1.0 / (b + 1)
    at = F.abs(F.col("p_emp") - least) <= 1e-15
    g = fam.groupBy("gene").agg(F.count(F.lit(1)).alias("m"), F.count_if(at).alias("n_floor"), F.count_if(at & ~F.col("significant")).alias("n_lost"))
    r = least * F.col("m") / q
    need = (F.ceil(safety * F.col("m") / (target * q)) - 1).cast("long")
    step = F.array_min(F.filter(F.array(*(F.lit(x) for x in ladder)), lambda x: x >= F.col("b_required")))
    g = g.withColumns({"c0": F.lit(least > q), "c1": r > 1, "c2": (F.col("n_floor") > 0) & (F.col("n_floor") < r), "c3": F.col("n_lost") > 0, "b_required": need})
    return g.withColumn("limited", F.col("c0") | F.col("c1") | F.col("c2") | F.col("c3")).withColumn("b_recommended", F.when(F.col("b_required") <= most, step))


def label_floors(labelled: DataFrame, occupied: DataFrame) -> DataFrame:
    """(gene, n_l, p_floor): the least p that shuffled labels allow a sphere of n_l labelled residues, for each n_l that occurs."""
    size = labelled.groupBy("gene").agg(F.count(F.lit(1)).cast("int").alias("m_all"), F.count_if(F.col("class") == "PLP").cast("int").alias("n_plp"))
    o = occupied.where("n_l > 0").select("gene", F.col("n_l").cast("int").alias("n_l")).distinct().join(size, "gene").join(st.ln_factorials(size), "gene")
    return o.select("gene", "n_l", st.hypergeometric_tail(F.least("n_l", "n_plp"), F.col("m_all"), F.col("n_plp"), F.col("n_l")).alias("p_floor"))
