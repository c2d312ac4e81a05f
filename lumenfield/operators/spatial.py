"""Points in space: pairs, range joins, nearest points, occupancy and coverage. All partition by gene."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import distance
from . import pairs as pr

POINT = ["gene", "residue_index", "x", "y", "z"]


def pairs(u: DataFrame) -> DataFrame:
    """All pairs i < j of a gene's positions with their distance (a gene has hundreds to thousands of positions)."""
    a, b = u.select(*POINT), u.select("gene", F.col("residue_index").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    return a.join(b, "gene").where("residue_index < j").select("gene", F.col("residue_index").alias("i"), "j", distance().alias("d"))


def range_join(centers: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(gene, center, point, d) with d <= radius, self pairs included: each point goes to the 27 cells around its own,
    and cells meet by equality, so no pair beyond two cells is ever made."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    a = centers.select("gene", F.col("residue_index").alias("center"), "x", "y", "z", *(cell(c).alias(f"c{c}") for c in "xyz"))
    step = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
    b = points.select("gene", F.col("residue_index").alias("point"), *(F.col(c).alias(f"{c}2") for c in "xyz"), *(cell(c).alias(f"c{c}") for c in "xyz"))
    for c in "xyz":
        b = b.withColumn("_s", step).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_s")).drop("_s")
    # Spark doesn't count what explode adds, so it must not choose to broadcast b
    met = a.join(b.hint("merge"), ["gene", "cx", "cy", "cz"])
    return met.withColumn("d", distance()).where(F.col("d") <= radius).select("gene", "center", "point", "d")


def within(centers: DataFrame, points: DataFrame, radius: float | DataFrame) -> DataFrame:
    """range_join() at one radius, or at each gene's own from a table (gene, radius) of one row a gene."""
    if not isinstance(radius, DataFrame):
        return range_join(centers, points, radius)
    # cells as wide as each gene's own radius
    wide = lambda df: df.join(radius.select("gene", F.col("radius").alias("_r")), "gene").select(*POINT, "_r")
    scaled = lambda df: wide(df).select("gene", "residue_index", *((F.col(c) / F.col("_r")).alias(c) for c in "xyz"), *(F.col(c).alias(f"{c}0") for c in "xyz"), "_r")
    met = range_join(scaled(centers), scaled(points), 1.000001).select("gene", "center", "point")
    a = wide(centers).select("gene", F.col("residue_index").alias("center"), "x", "y", "z", "_r")
    b = points.select("gene", F.col("residue_index").alias("point"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    exact = met.join(a, ["gene", "center"]).join(b, ["gene", "point"]).withColumn("d", distance())
    return exact.where(F.col("d") <= F.col("_r")).select("gene", "center", "point", "d")


def nearest(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(gene, point, center, d): each point's nearest centre, ties to the smaller number."""
    tiles = points.groupBy("gene").agg(F.ceil(F.count(F.lit(1)) / pr.PART).cast("int").alias("_tiles"))
    a = points.select(*POINT).join(tiles, "gene").withColumn("_tile", F.pmod(F.xxhash64("residue_index"), F.col("_tiles")).cast("int"))
    b = centers.select(*POINT).join(tiles, "gene").withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))

    def kernel(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame()
        q = q.sort_values("residue_index")
        best, at = np.full(len(p), np.nan), np.zeros(len(p), int)
        for rows, cols, d2 in pr.blocks(pr.xyz(p), pr.xyz(q)):
            d = np.sqrt(d2, out=d2)
            k = d.argmin(axis=1)
            d = d[np.arange(len(d)), k]
            nearer = ~(best[rows] <= d)  # blocks come in the order of their centres
            best[rows], at[rows] = np.where(nearer, d, best[rows]), np.where(nearer, k + cols.start, at[rows])
        return pd.DataFrame({"gene": p["gene"], "point": p["residue_index"], "center": q["residue_index"].to_numpy()[at], "d": best})

    n = pr.tasks(points)
    dealt = lambda df: df.select(*(F.col(c).alias(c) for c in (*POINT, "_tile"))).repartition(n, "gene", "_tile").groupBy("gene", "_tile")
    kind = lambda df: df.schema["residue_index"].dataType.simpleString()
    return dealt(a).cogroup(dealt(b)).applyInPandas(kernel, f"gene string, point {kind(points)}, center {kind(centers)}, d double")


def covered(points: DataFrame, centers: DataFrame, radius: float, how: str = "left_semi") -> DataFrame:
    """Points within radius of a centre (left_semi), or of none (left_anti)."""
    hit = range_join(centers, points, radius).select("gene", F.col("point").alias("residue_index"))
    return points.join(hit, ["gene", "residue_index"], how)


def occupancies(u: DataFrame, labelled: DataFrame, radii: list[float], by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, residue_index, radius, n_u, n_l, n_p): occupancy() for every radius, counted without a row for each pair."""
    code = labelled.select(*by, "residue_index", F.when(F.col("class") == "PLP", 2).when(F.col("class").isNotNull(), 1).alias("code"))
    points = u.select(*by, "residue_index", "x", "y", "z").join(code, [*by, "residue_index"], "left").fillna(0, ["code"])

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        c = pr.ball_counts(pr.xyz(a), pr.xyz(b), b["code"].to_numpy(), radii)
        n = lambda i: c[:, i].ravel()
        rows = {k: np.tile(a[k].to_numpy(), len(radii)) for k in (*by, "residue_index")}
        out = pd.DataFrame(rows | {"radius": np.repeat(np.array(radii, float), len(a)), "n_u": n(0), "n_l": n(1), "n_p": n(2)})
        return out[out["n_u"] > 0]

    schema = f"{pr.typed(u, *by, 'residue_index')}, radius double, n_u long, n_l long, n_p long"
    return pr.near_groups(u.select(*by, "residue_index", "x", "y", "z"), points, max(radii), kernel, schema, by)


def occupancy(u: DataFrame, labelled: DataFrame, radius: float, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """Per centre: n_u positions, n_l labelled and n_p P/LP ones within radius (itself included)."""
    return occupancies(u, labelled, [float(radius)], by).drop("radius")


def spread(u: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, n_pairs, d_sum, d_max) of all pairs of each set; a set of one point has no row."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        n, total, far = pr.pair_sums(pr.xyz(a), None if b is None else pr.xyz(b))
        return pd.DataFrame({**{k: [a[k].iat[0]] for k in by}, "n_pairs": [n], "d_sum": [total], "d_max": [far]})

    parts = pr.tile_groups(u.select(*by, "residue_index", "x", "y", "z"), kernel, f"{pr.typed(u, *by)}, n_pairs long, d_sum double, d_max double", by)
    return parts.where("n_pairs > 0").groupBy(*by).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("d_sum").alias("d_sum"), F.max("d_max").alias("d_max"))


def box_volume(u: DataFrame) -> DataFrame:
    """(gene, volume): of the bounding box."""
    side = lambda c: F.max(c) - F.min(c)
    return u.groupBy("gene").agg((side("x") * side("y") * side("z")).alias("volume"))


def ripley(points: DataFrame, u: DataFrame, grid: list[float], width: float = 1.0, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """K, L and pair correlation g of point sets ``by`` over a grid of radii; the intensity is the set's own."""
    r = F.explode(F.array(*(F.lit(float(x)) for x in grid))).alias("r")
    n = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    # a pair counts once, at the first edge that is no less than d; a radius then sums the edges up to r and r -/+ width / 2
    edges = sorted({e for x in grid for e in (float(x), x - width / 2, x + width / 2)})

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        n_e = pr.pair_histogram(pr.xyz(a)[None], None if b is None else pr.xyz(b), np.array(edges))[0, :-1]
        some = np.flatnonzero(n_e)
        return pd.DataFrame({**{k: [a[k].iat[0]] * len(some) for k in by}, "edge": np.array(edges)[some], "n_e": n_e[some]})

    parts = pr.tile_groups(points.select(*by, "residue_index", "x", "y", "z"), kernel, f"{pr.typed(points, *by)}, edge double, n_e long", by)
    bins = parts.groupBy(*by, "edge").agg(F.sum("n_e").alias("n_e"))
    upto = lambda e: F.sum(F.when(F.col("edge") <= e, F.col("n_e")).otherwise(0))
    cum = bins.select("*", r).groupBy(*by, "r").agg(upto(F.col("r")).alias("cum"), (upto(F.col("r") + width / 2) - upto(F.col("r") - width / 2)).alias("shell"))
    s = n.select("*", r).join(cum, [*by, "r"], "left").fillna(0, ["cum", "shell"]).join(box_volume(u), "gene")
    lam = F.col("n") / F.col("volume")
    k = F.when(F.col("n") < 2, 0.0).otherwise(2 * F.col("cum") / F.col("n") / lam)
    g = F.when(F.col("n") < 2, 0.0).otherwise(2 * F.col("shell") / F.col("n") / (lam * 4 * F.pi() * F.pow("r", F.lit(2)) * width))
    return s.withColumn("k", k).withColumn("l", F.cbrt(3 * F.col("k") / (4 * F.pi()))).withColumn("g", g)


def longest_run(df: DataFrame, flag: Column, step: float = 1.0) -> DataFrame:
    """(gene, start, stop, n) of the longest run of grid points where flag holds; ties to the smallest start."""
    key = F.round(F.col("r") / step).cast("int")
    on = df.where(flag).withColumn("_g", key - F.row_number().over(Window.partitionBy("gene").orderBy("r")))
    runs = on.groupBy("gene", "_g").agg(F.min("r").alias("start"), F.max("r").alias("stop"), F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("n"), "start"))
    return runs.withColumn("_b", best).where("_b = 1").drop("_b", "_g")


def peaks(curve: DataFrame) -> DataFrame:
    """Local maxima of g: strictly above the point before, at least the point after. Beyond either end g counts as minus infinity."""
    w, low = Window.partitionBy("gene").orderBy("r"), F.lit(float("-inf"))
    before, after = F.coalesce(F.lag("g").over(w), low), F.coalesce(F.lead("g").over(w), low)
    return curve.withColumn("_b", before).withColumn("_a", after).where("g > _b and g >= _a").drop("_b", "_a")


def gyration(u: DataFrame) -> DataFrame:
    """Centroid and radius of gyration per gene."""
    g = u.groupBy("gene").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"), *(F.avg(F.col(c) * F.col(c)).alias(f"q{c}") for c in "xyz"))
    spread = sum(F.col(f"q{c}") - F.col(f"c{c}") * F.col(f"c{c}") for c in "xyz")
    return g.select("gene", "cx", "cy", "cz", F.sqrt(spread).alias("radius_of_gyration"))


def null_curves(points: DataFrame, u: DataFrame, drawn: DataFrame, grid: list[float], b: int, width: float = 1.0) -> DataFrame:
    """Per gene and radius: K, L and g of the points, with mean, sd and 2.5 and 97.5 percentiles of each over b draws of as many positions
    (drawn: gene, b, residue_index), the 95th percentile of g, and Z of K and g (0 where the sd is 0)."""
    sets = drawn.hint("merge").join(u.select(*POINT), ["gene", "residue_index"])  # draws are more than Spark takes them for
    null = ripley(sets, u, grid, width, by=("gene", "b"))
    stats = []
    for c in ("k", "l", "g"):
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.percentile(c, 0.025).alias(f"{c}_lo"), F.percentile(c, 0.975).alias(f"{c}_hi")]
    e = null.groupBy("gene", "r").agg(*stats, F.percentile("g", 0.95).alias("g_p95"), F.count(F.lit(1)).alias("n_draws"))
    out = ripley(points, u, grid, width).select("gene", "r", "k", "l", "g").join(e, ["gene", "r"])
    z = lambda c: F.when(F.col(f"{c}_sd") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).otherwise(0.0).alias(f"{c}_z")
    return out.select("*", z("k"), z("g"))


def global_test(points: DataFrame, u: DataFrame, drawn: DataFrame, curves: DataFrame, grid: list[float], b: int, width: float = 1.0) -> DataFrame:
    """Per gene: T, the largest |Z| of K over the radii, and its add-one p over the draws, each of which is standardised alike."""
    sets = drawn.hint("merge").join(u.select(*POINT), ["gene", "residue_index"])  # draws are more than Spark takes them for
    null = ripley(sets, u, grid, width, by=("gene", "b")).join(curves.select("gene", "r", F.col("k_mean").alias("m"), F.col("k_sd").alias("s")), ["gene", "r"])
    t = null.groupBy("gene", "b").agg(F.max(F.abs(F.when(F.col("s") > 0, (F.col("k") - F.col("m")) / F.col("s")).otherwise(0.0))).alias("t"))
    obs = curves.groupBy("gene").agg(F.max(F.abs("k_z")).alias("t_obs"))
    return t.join(obs, "gene").groupBy("gene", "t_obs").agg(((F.count_if(F.col("t") >= F.col("t_obs")) + 1) / (b + 1)).alias("p_global"))


def radius_domain(curves: DataFrame, points: DataFrame, u: DataFrame, floor: float = 5.0, ceiling: float = 25.0, step: float = 0.5, margin: float = 1.0, least_points: int = 10, least_run: float = 2.0, least_grid: int = 5) -> DataFrame:
    """Per gene: the radii to search. Those where g is over 1 and over its null's 95th percentile make runs; the longest, a margin wider and
    clamped to [floor, min(ceiling, D_max / 4)], is the domain. It falls back to that whole interval if there is no run (FT-1), the
    run is too short (FT-2), the grid has too few points (FT-3), or there are too few points (FT-4); a structure that the
    floor doesn't fit into has none."""
    run = longest_run(curves.where(F.col("r").isNotNull()), (F.col("g") > 1) & (F.col("g") > F.col("g_p95"))).select("gene", "start", "stop")
    n = points.groupBy("gene").agg(F.count(F.lit(1)).alias("n_points"))
    far = spread(u).select("gene", "d_max")
    d = u.select("gene").distinct().join(far, "gene", "left").join(n, "gene", "left").join(run, "gene", "left").fillna(0, ["n_points"])
    d = d.withColumn("cap", F.least(F.lit(ceiling), F.coalesce("d_max", F.lit(0.0)) / 4))
    size = lambda lo, hi: F.greatest(F.lit(0), F.floor(F.round((hi - lo) / step, 9)) + 1)
    lo, hi = F.greatest(F.lit(floor), F.col("start") - margin), F.least(F.col("cap"), F.col("stop") + margin)
    d = d.withColumn("own_grid", size(lo, hi)).withColumn("own_lo", lo).withColumn("own_hi", hi)
    fired = (("FT-1", F.col("start").isNull()), ("FT-2", F.col("stop") - F.col("start") < least_run), ("FT-3", F.col("own_grid") < least_grid), ("FT-4", F.col("n_points") < least_points))
    d = d.withColumn("triggers", F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in fired)), lambda x: x.isNotNull()))
    fits, back = F.col("cap") >= floor, F.size("triggers") > 0
    source = F.when(~fits, "inadmissible").when(back, "fallback_envelope").otherwise("pcf_derived")
    low, high = F.when(fits, F.when(back, F.lit(floor)).otherwise(F.col("own_lo"))), F.when(fits, F.when(back, F.col("cap")).otherwise(F.col("own_hi")))
    return d.select("gene", "d_max", "cap", F.col("start").alias("run_start"), F.col("stop").alias("run_stop"), "triggers", source.alias("source"), low.alias("lo"), high.alias("hi"), F.when(fits, size(low, high)).otherwise(0).cast("long").alias("n_grid"))
