"""Footprints: evidence and containment radius, voxel distance, descriptors, and set comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import distance
from . import spatial as sp


def evidence(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """Each P/LP residue with its nearest centre and distance."""
    return sp.nearest(labelled.where("class = 'PLP'"), centers).select("gene", F.col("point").alias("residue_index"), "center", "d")


def containment(ev: DataFrame, r_hot: float | DataFrame, step: float = 0.5) -> DataFrame:
    """Per gene, of the P/LP residues of evidence(): how many there are and how many lie within r_hot of their centre (the evidence set; r_hot
    is a number, or a table of one radius a gene), the smallest radius that contains those, that radius rounded up to
    a multiple of step, and the residue that binds it. Quartiles and Tukey's fence are of the evidence set and decide nothing: they
    only tell whether the binding residue is an outlier. A gene without evidence has no row."""
    own = ev.withColumn("r_hot", F.lit(float(r_hot))) if not isinstance(r_hot, DataFrame) else ev.join(r_hot.select("gene", F.col("radius").alias("r_hot")), "gene")
    inside = F.when(F.col("d") <= F.col("r_hot"), F.col("d"))
    g = own.withColumn("inside", inside).groupBy("gene").agg(
        F.count(F.lit(1)).alias("n"), F.count("inside").alias("n_in"), F.max("inside").alias("exact"), F.max_by("residue_index", F.when(F.col("inside").isNotNull(), F.struct("d", -F.col("residue_index")))).alias("binding"),
        *(F.percentile("inside", q).alias(k) for k, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))),
    )
    fence = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    g = g.where("n_in > 0").withColumn("radius", F.ceil(F.col("exact") / step) * step).withColumn("fence", fence)
    return g.withColumn("binding_is_outlier", F.col("exact") > F.col("fence")).withColumn("share_outside", (F.col("n") - F.col("n_in")) / F.col("n"))


def voxels(centers: DataFrame, rho: float, h: float, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, ix, iy, iz, d2): voxels within rho of a seed voxel, with the squared distance in voxels. A point's voxel is
    floor(q / h + 1e-9); distances are between voxel centres, as integers, so no boundary depends on rounding."""
    n = int(rho / h + 1e-9)
    seeds = centers.select(*by, *(F.floor(F.col(c) / h + 1e-9).alias(f"s{c}") for c in "xyz")).distinct()
    # the ball of offsets around a seed: its size follows from rho / h alone
    axis = F.sequence(F.lit(-n), F.lit(n))
    ball = seeds.withColumn("dx", F.explode(axis)).withColumn("dy", F.explode(axis)).withColumn("dz", F.explode(axis))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    near = ball.withColumn("d2", d2).where(F.col("d2") <= math.floor((rho / h) ** 2 + 1e-9))
    return near.groupBy(*by, (F.col("sx") + F.col("dx")).alias("ix"), (F.col("sy") + F.col("dy")).alias("iy"), (F.col("sz") + F.col("dz")).alias("iz")).agg(F.min("d2").alias("d2"))


def surface(v: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """Voxels with an empty face neighbour, and how many faces are open."""
    steps = F.explode(F.array(*(F.struct(*(F.lit(s if k == a else 0).alias(f"e{c}") for k, c in enumerate("xyz"))) for a in range(3) for s in (-1, 1)))).alias("e")
    faces = v.select(*by, "ix", "iy", "iz", steps).select(*by, "ix", "iy", "iz", *((F.col(f"i{c}") + F.col(f"e.e{c}")).alias(f"n{c}") for c in "xyz"))
    full = v.select(*by, *(F.col(f"i{c}").alias(f"n{c}") for c in "xyz"))
    open_faces = faces.join(full, [*by, "nx", "ny", "nz"], "left_anti")
    return open_faces.groupBy(*by, "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("open_faces"))


def _components(points: np.ndarray) -> np.ndarray:
    """Labels from 1 of face-connected voxels, by union of neighbours found in sorted keys."""
    p = points - points.min(axis=0) + 1
    side = p.max(axis=0) + 2
    key = (p[:, 0] * side[1] + p[:, 1]) * side[2] + p[:, 2]
    order = np.argsort(key)
    key = key[order]
    label = np.arange(len(key))
    links = []
    for step in (1, side[2], side[1] * side[2]):
        at = np.searchsorted(key, key + step)
        hit = np.flatnonzero((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step))
        links.append((hit, at[hit]))
    a, b = np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(key), int)
    out[order] = np.unique(label, return_inverse=True)[1] + 1
    return out


def components(v: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """v with a component number; a footprint's voxels go to one task (a gene's: some hundred thousand; see voxel_edge)."""
    schema = v.withColumn("component", F.lit(0)).schema
    return v.groupBy(*by).applyInPandas(lambda pdf: pdf.assign(component=_components(pdf[["ix", "iy", "iz"]].to_numpy())), schema)


#: Voxels of a gene's grid beyond which the coarser edge is taken.
MAX_VOXELS = 100_000_000


def voxel_edge(centers: DataFrame, rho: float, h: float = 0.5, coarse: float = 1.0, pad: float = 2.0) -> DataFrame:
    """(gene, n_voxels, h): voxels of the box around a gene's centres, rho and pad wide, and the edge to use for it."""
    side = lambda c: F.ceil((F.max(c) - F.min(c) + 2 * (rho + pad)) / h)
    g = centers.groupBy("gene").agg((side("x") * side("y") * side("z")).alias("n_voxels"))
    return g.withColumn("h", F.when(F.col("n_voxels") > MAX_VOXELS, F.lit(coarse)).otherwise(F.lit(h)))


def eroded(v: DataFrame, depth: float, h: float, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """The voxels of v that no empty voxel is nearer to than depth. The nearest empty voxel always has a face in common with a
    full one, so only those are looked from, and only as far as depth."""
    n = int(depth / h)
    around = F.explode(F.array(*(F.struct(*(F.lit(s if k == a else 0).alias(f"e{c}") for k, c in enumerate("xyz"))) for a in range(3) for s in (-1, 1)))).alias("e")
    empty = v.select(*by, "ix", "iy", "iz", around).select(*by, *((F.col(f"i{c}") + F.col(f"e.e{c}")).alias(f"i{c}") for c in "xyz")).distinct().join(v, [*by, "ix", "iy", "iz"], "left_anti")
    axis = F.sequence(F.lit(-n), F.lit(n))
    ball = empty.withColumn("dx", F.explode(axis)).withColumn("dy", F.explode(axis)).withColumn("dz", F.explode(axis))
    near = ball.where((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")) * h * h < depth * depth - 1e-9)
    return v.join(near.select(*by, *((F.col(f"i{c}") + F.col(f"d{c}")).alias(f"i{c}") for c in "xyz")).distinct(), [*by, "ix", "iy", "iz"], "left_anti")


def bridges(v: DataFrame, rho: float, h: float, by: tuple[str, ...] = ("gene",), share: float = 0.15) -> DataFrame:
    """Per footprint: components, components after erosion by share * rho, the thin connections that the erosion breaks, and their index."""
    count = lambda x, name: components(x, by).groupBy(*by).agg(F.count_distinct("component").alias(name))
    g = count(v, "n_components").join(count(eroded(v, share * rho, h, by), "n_eroded"), list(by), "left").fillna(0, ["n_eroded"])
    n = F.greatest(F.lit(0), F.col("n_eroded") - F.col("n_components"))
    return g.withColumn("n_bridges", n).withColumn("bridging_index", n / F.greatest(F.lit(1), F.col("n_eroded")))


def _depth2(points: np.ndarray) -> np.ndarray:
    """Squared distance, in voxels, from each full voxel to the nearest empty one, one axis after the other."""
    low = points.min(axis=0) - 1
    box = np.zeros(points.max(axis=0) - low + 2, bool)
    at = tuple((points - low).T)
    box[at] = True
    d = np.where(box, np.iinfo(np.int64).max // 4, 0)
    for axis in range(3):
        d, out = np.moveaxis(d, axis, 0), None
        out = d.copy()
        for k in range(1, len(d)):
            if k * k >= out.max():
                break
            np.minimum(out[k:], d[:-k] + k * k, out=out[k:])
            np.minimum(out[:-k], d[k:] + k * k, out=out[:-k])
        d = np.moveaxis(out, 0, axis)
    return d[at]


def bottlenecks(v: DataFrame, pairs: DataFrame, h: float, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, a, b, neck): for pairs of centres (by, a, b, ax..az, bx..bz: their voxels), half the width of the widest way between
    them inside the footprint; NaN if there is none. The largest depth at which both are still in one component is found by halving."""

    def kernel(vox: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(vox) and len(ask):
            p = vox[["ix", "iy", "iz"]].to_numpy()
            d2, number = _depth2(p), {tuple(x): i for i, x in enumerate(p.tolist())}
            levels = np.unique(d2)
            for r in ask.itertuples():
                a, b = number.get((r.ax, r.ay, r.az)), number.get((r.bx, r.by, r.bz))
                neck = float("nan")
                if a is not None and b is not None:
                    low, high = -1, len(levels) - 1
                    while low < high:
                        mid = (low + high + 1) // 2
                        keep = d2 >= levels[mid]
                        joined = False
                        if keep[a] and keep[b]:
                            label = np.zeros(len(p), int)
                            label[keep] = _components(p[keep])
                            joined = label[a] == label[b]
                        low, high = (mid, high) if joined else (low, mid - 1)
                    neck = float(np.sqrt(levels[low]) * h) if low >= 0 else neck
                rows.append((*(getattr(r, f"of_{k}") for k in by), r.a, r.b, neck))
        return pd.DataFrame(rows, columns=[*by, "a", "b", "neck"])

    keys = [F.col(k).alias(f"of_{k}") for k in by]
    ask = pairs.select(*keys, "a", "b", "ax", "ay", "az", "bx", "by", "bz")
    schema = ", ".join(f"{k} {v.schema[k].dataType.simpleString()}" for k in by) + ", a int, b int, neck double"
    found = v.groupBy(*by).cogroup(ask.groupBy(*(f"of_{k}" for k in by))).applyInPandas(kernel, schema)
    return found.withColumn("neck", F.coalesce("neck", F.lit(float("nan"))))  # pandas hands NaN over as null


def seed_voxels(centers: DataFrame, h: float) -> DataFrame:
    """(gene, residue_index, ix, iy, iz): the voxel of each centre."""
    return centers.select("gene", "residue_index", *(F.floor(F.col(c) / h + 1e-9).alias(f"i{c}") for c in "xyz"))


def sweep_voxels(centers: DataFrame, radii: list[float], h: float) -> DataFrame:
    """voxels() of every radius rho, from one pass at the largest."""
    v = voxels(centers, max(radii), h)
    each = F.explode(F.array(*(F.struct(F.lit(float(r)).alias("rho"), F.lit(math.floor((r / h) ** 2 + 1e-9)).alias("most")) for r in radii))).alias("r")
    return v.select("*", each).where("d2 <= r.most").select("gene", F.col("r.rho").alias("rho"), "ix", "iy", "iz", "d2")


def center_labels(centers: DataFrame, labelled: DataFrame, h: float) -> DataFrame:
    """(gene, rho, residue_index, group): the component of each centre's voxel, named by its smallest centre."""
    own = seed_voxels(centers, h).join(labelled, ["gene", "ix", "iy", "iz"])
    return own.select("gene", "rho", "residue_index", F.min("residue_index").over(Window.partitionBy("gene", "rho", "component")).alias("group"))


def merges(labels: DataFrame) -> DataFrame:
    """(gene, rho, group, before): components that were apart at the radius before and are one at rho, with the centres that named them."""
    grid = labels.select("gene", "rho").distinct().withColumn("last", F.lag("rho").over(Window.partitionBy("gene").orderBy("rho")))
    before = labels.select("gene", F.col("rho").alias("last"), "residue_index", F.col("group").alias("was"))
    g = labels.join(grid, ["gene", "rho"]).join(before, ["gene", "last", "residue_index"]).groupBy("gene", "rho", "group").agg(F.array_sort(F.collect_set("was")).alias("before"))
    return g.where(F.size("before") > 1)


def merge_necks(centers: DataFrame, labels: DataFrame, v: DataFrame, h: float, share: float = 0.15) -> DataFrame:
    """(gene, rho, a, b, neck, depth, connection): of each merge, every pair of neighbours among the components that it joins, these in the
    order of their first centres, which name them. A neck of at least share * rho is natural, a thinner one artificial, one without a way undetermined."""
    m = merges(labels)
    pair = F.transform(F.slice("before", 1, F.size("before") - 1), lambda a, i: F.struct(a.cast("int").alias("a"), F.element_at("before", i + 2).cast("int").alias("b")))
    each = m.select("gene", "rho", F.explode(pair).alias("p")).select("gene", "rho", "p.a", "p.b")
    seeds = seed_voxels(centers, h)
    at = lambda c: seeds.select("gene", F.col("residue_index").cast("int").alias(c), *(F.col(f"i{k}").cast("int").alias(f"{c}{k}") for k in "xyz"))
    asked = each.join(at("a"), ["gene", "a"]).join(at("b"), ["gene", "b"])
    inside = v.join(asked.select("gene", "rho").distinct(), ["gene", "rho"], "left_semi")
    depth = share * F.col("rho")
    kind = F.when(F.isnan("neck"), "undetermined").when(F.col("neck") >= depth, "natural").otherwise("artificial")
    return bottlenecks(inside, asked, h, ("gene", "rho")).select("gene", "rho", "a", "b", "neck", depth.alias("depth"), kind.alias("connection"))


def sweep(u: DataFrame, centers: DataFrame, radii: list[float], h: float) -> DataFrame:
    """A row for each gene and radius rho: voxels, volume, components, share of the largest, coverage of residues, changes since the
    radius before, rate of expansion (slope of log volume; one-sided at the ends), monotonicity, and abrupt transitions (a change of
    components by 2 or more, or a rate of twice the gene's median)."""
    c = components(sweep_voxels(centers, radii, h), ("gene", "rho")).groupBy("gene", "rho", "component").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("gene", "rho").agg(F.sum("n").alias("n_voxels"), F.count(F.lit(1)).cast("int").alias("n_components"), F.max("n").alias("largest"))
    each = F.explode(F.array(*(F.lit(float(r)) for r in radii))).alias("rho")
    near = sp.range_join(centers, u, max(radii)).groupBy("gene", "point").agg(F.min("d").alias("d"))
    inside = near.select("*", each).where("d <= rho").groupBy("gene", "rho").agg(F.count(F.lit(1)).alias("n_residues"))
    g = g.join(inside, ["gene", "rho"], "left").join(u.groupBy("gene").agg(F.count(F.lit(1)).alias("m_all")), "gene")
    w = Window.partitionBy("gene").orderBy("rho")
    ln, lag, lead = F.log(F.col("n_voxels").cast("double")), lambda x: F.lag(x).over(w), lambda x: F.lead(x).over(w)
    g = g.withColumns({"a": F.coalesce(lag(ln), ln), "b": F.coalesce(lead(ln), ln), "ra": F.coalesce(lag("rho"), F.col("rho")), "rb": F.coalesce(lead("rho"), F.col("rho"))})
    g = g.withColumns({"expansion_rate": F.when(F.col("rb") > F.col("ra"), (F.col("b") - F.col("a")) / (F.col("rb") - F.col("ra"))), "delta_components": F.col("n_components") - lag("n_components"), "delta_volume": (F.col("n_voxels") - lag("n_voxels")) * h**3})
    medians = g.groupBy("gene").agg(F.median("expansion_rate").alias("middle"))
    monotone = F.coalesce((F.col("delta_components") <= 0) & (F.col("delta_volume") >= -1e-9), F.lit(True))
    abrupt = F.coalesce(F.abs("delta_components") >= 2, F.lit(False)) | F.coalesce((F.col("middle") > 0) & (F.col("expansion_rate") >= 2 * F.col("middle")), F.lit(False))
    return g.join(medians, "gene").select("gene", "rho", "n_voxels", (F.col("n_voxels") * h**3).alias("volume"), "n_components", (F.col("largest") / F.col("n_voxels")).alias("connectivity"), (F.coalesce("n_residues", F.lit(0)) / F.col("m_all")).alias("coverage"), "delta_components", "delta_volume", "expansion_rate", monotone.alias("monotone"), abrupt.alias("abrupt"))


def verdicts(rows: DataFrame, max_coverage: float = 0.5, max_bridging: float = 0.5, escalate: float = 0.95) -> DataFrame:
    """rows (coverage, bridging_index, volume by gene and rho) with the failed rules, whether the radius is admissible, and whether so
    many radii of the gene are too wide that it has to be escalated."""
    wide = F.col("coverage") > max_coverage
    rules = (("F1_COVERAGE", wide), ("F2_BRIDGING", F.col("bridging_index").isNull() | F.isnan("bridging_index") | (F.col("bridging_index") > max_bridging)), ("F3_EMPTY", F.col("volume") <= 0))
    failed = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())
    share = F.avg(wide.cast("int")).over(Window.partitionBy("gene"))
    return rows.withColumn("failed", failed).withColumn("admissible", F.size("failed") == 0).withColumn("escalate", share >= escalate)


def residue_components(u: DataFrame, centers: DataFrame, labels: DataFrame, rho: float) -> DataFrame:
    """(gene, residue_index, center, group): each covered residue with the component of its nearest covering centre."""
    near = sp.range_join(centers, u, rho).groupBy("gene", "point").agg(F.min(F.struct("d", "center")).alias("m"))
    own = near.select("gene", F.col("point").alias("residue_index"), F.col("m.center").alias("center"))
    return own.join(labels.where(F.col("rho") == rho).select("gene", F.col("residue_index").alias("center"), "group"), ["gene", "center"])


def hull_volume(points: np.ndarray) -> float:
    """Volume of the convex hull, by adding one point after the other and renewing the faces that it sees; NaN for flat sets."""
    p = points - points.mean(axis=0)
    size = float(np.abs(p).max()) if len(p) else 0.0
    if len(p) < 4 or size == 0:
        return float("nan")
    a = int(np.argmin(p[:, 0]))
    b = int(np.argmax(np.linalg.norm(p - p[a], axis=1)))
    c = int(np.argmax(np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1)))
    side = (p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.argmax(np.abs(side)))
    if abs(side[d]) < 1e-9 * size**3:
        return float("nan")
    inner = p[[a, b, c, d]].mean(axis=0)

    def outward(f: np.ndarray) -> np.ndarray:
        x = p[f]
        n = np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0])
        turn = ((inner - x[:, 0]) * n).sum(axis=1) > 0
        f[turn] = f[turn][:, [0, 2, 1]]
        return f

    faces = outward(np.array([[a, b, c], [a, b, d], [a, c, d], [b, c, d]]))
    for i in range(len(p)):
        x = p[faces]
        n = np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0])
        seen = ((p[i] - x[:, 0]) * n).sum(axis=1) > 1e-9 * size**3
        if not seen.any():
            continue
        edges = np.concatenate([faces[seen][:, [0, 1]], faces[seen][:, [1, 2]], faces[seen][:, [2, 0]]])
        both = {tuple(e) for e in edges.tolist()}
        rim = [(s, t) for s, t in both if (t, s) not in both]
        faces = np.concatenate([faces[~seen], np.array([(s, t, i) for s, t in rim])])
    x = p[faces] - inner
    return float((x[:, 0] * np.cross(x[:, 1], x[:, 2])).sum() / 6)


def convexity(v: DataFrame, h: float, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """Per footprint: its volume, that of the convex hull of its voxels' centres, and their ratio, which may be over 1; both NaN where the
    centres have no volume. Of each run of voxels along x only the ends go to the kernel: no other voxel can be a corner of the hull."""
    ends = v.groupBy(*by, "iy", "iz").agg(F.min("ix").alias("lo"), F.max("ix").alias("hi"), F.count(F.lit(1)).alias("n"))
    schema = ", ".join(f"{k} {v.schema[k].dataType.simpleString()}" for k in by) + ", volume double, hull double"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        yz = pdf[["iy", "iz"]].to_numpy()
        corners = np.unique(np.concatenate([np.column_stack([pdf[end], yz]) for end in ("lo", "hi")]), axis=0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "volume": [float(pdf["n"].sum()) * h**3], "hull": [hull_volume(corners.astype(float)) * h**3]})

    return ends.groupBy(*by).applyInPandas(kernel, schema).withColumn("hull", F.coalesce("hull", F.lit(float("nan")))).withColumn("convexity", F.col("volume") / F.col("hull"))


def descriptors(v: DataFrame, h: float, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """Volume, number of components, share of the largest, exposed face area, and sphericity from it."""
    c = components(v, by).groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy(*by).agg(F.sum("n").alias("n_voxels"), F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"))
    area = surface(v, by).groupBy(*by).agg((F.sum("open_faces") * h * h).alias("face_area"))
    volume = F.col("n_voxels") * h**3
    return g.join(area, list(by)).withColumn("volume", volume).withColumn("connectivity", F.col("largest") / F.col("n_voxels")).withColumn("compactness", F.cbrt(36 * F.pi() * volume * volume) / F.col("face_area"))


def rand_index(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Adjusted Rand index of two labellings; with fewer than two items it is 0."""
    cell = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    part = lambda c: cell.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two("n")).alias(f"s_{c}"))
    s = cell.groupBy(*by).agg(F.sum(two("n")).alias("s"), F.sum("n").alias("total")).join(part(a), by).join(part(b), by)
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / two("total")
    top = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return s.select(*by, F.when(F.col("total") < 2, 0.0).when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))


def hausdorff95(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per gene: the larger of both directions' 95th percentile of nearest distances; NaN for a gene with an empty side."""
    one = lambda p, q, n: sp.nearest(p, q).groupBy("gene").agg(F.percentile("d", 0.95).alias(n))
    every = a.select("gene").union(b.select("gene")).distinct()
    both = every.join(one(a, b, "ab"), "gene", "left").join(one(b, a, "ba"), "gene", "left")
    return both.select("gene", F.when(F.col("ab").isNotNull() & F.col("ba").isNotNull(), F.greatest("ab", "ba")).otherwise(F.lit(float("nan"))).alias("hausdorff95"))


def spanning_edges(centers: DataFrame) -> DataFrame:
    """Minimum spanning tree of each gene's centres (Prim from the first; ties to the smaller number)."""

    def prim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("residue_index")
        p, ids = pdf[["x", "y", "z"]].to_numpy(), pdf["residue_index"].to_numpy()
        best, parent, left = np.full(len(p), np.inf), np.zeros(len(p), int), np.ones(len(p), bool)
        at, rows = 0, []
        for _ in range(len(p) - 1):
            left[at] = False
            d = np.sqrt(((p - p[at]) ** 2).sum(axis=1))
            nearer = left & (d < best)
            best[nearer], parent[nearer] = d[nearer], at
            at = int(np.argmin(np.where(left, best, np.inf)))
            rows.append((pdf["gene"].iloc[0], int(ids[parent[at]]), int(ids[at]), float(best[at])))
        return pd.DataFrame(rows, columns=["gene", "i", "j", "d"])

    return centers.groupBy("gene").applyInPandas(prim, "gene string, i int, j int, d double")


def leave_one_center_out(u: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """Per removed centre: the covered set's Jaccard, Dice and loss against the whole, with the rank of its influence. A residue is lost
    if the removed centre alone covers it."""
    near = sp.range_join(centers, u, radius)
    n = near.groupBy("gene", "point").agg(F.count(F.lit(1)).alias("n_covering"))
    total = n.groupBy("gene").agg(F.count(F.lit(1)).alias("n_all"))
    lost = near.join(n, ["gene", "point"]).groupBy("gene", F.col("center").alias("removed")).agg(F.count_if(F.col("n_covering") == 1).alias("n_lost"))
    r = lost.join(F.broadcast(total), "gene").withColumn("jaccard", (F.col("n_all") - F.col("n_lost")) / F.col("n_all")).withColumn("dice", 2 * (F.col("n_all") - F.col("n_lost")) / (2 * F.col("n_all") - F.col("n_lost")))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("gene").orderBy("jaccard", "removed")))


def subset_design(n: int, cap: int, seed: int) -> list[tuple[int, ...]]:
    """Removal subsets of 1 to min(n - 1, n div 2) of n: sizes are exhausted from the smallest on while the cap allows; the rest of it is
    shared evenly by the larger sizes, drawn without repetition. Counts are Python's big integers, made on the driver."""
    import itertools
    import random

    top, out, left = min(n - 1, n // 2), [], cap
    sizes = list(range(1, top + 1))
    while sizes and math.comb(n, sizes[0]) <= left // len(sizes):
        k = sizes.pop(0)
        out += list(itertools.combinations(range(n), k))
        left -= math.comb(n, k)
    rng = random.Random(seed)
    for i, k in enumerate(sizes):
        share = min(left // (len(sizes) - i), math.comb(n, k))
        ranks: set[int] = set()
        while len(ranks) < share:
            ranks.add(rng.randrange(math.comb(n, k)))
        out += [unrank(r, n, k) for r in sorted(ranks)]
        left -= share
    return out


def unrank(rank: int, n: int, k: int) -> tuple[int, ...]:
    """The subset of that place in lexicographic order."""
    out, start = [], 0
    for left in range(k, 0, -1):
        while (c := math.comb(n - start - 1, left - 1)) <= rank:
            rank -= c
            start += 1
        out.append(start)
        start += 1
    return tuple(out)


def bca(values: np.ndarray, seed: int, resamples: int = 10_000, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated bootstrap interval of the mean; the plain value where all are equal, NaN below two."""
    low, high, _ = bca_with_method(values, seed, resamples, level)
    return low, high


def bca_with_method(values: np.ndarray, seed: int, resamples: int = 10_000, level: float = 0.95) -> tuple[float, float, str]:
    """bca() and how the interval was made: "bca", or "percentile" where no or every resample is below the mean or the
    acceleration isn't defined, "constant", or "undefined"."""
    from statistics import NormalDist

    v, nd = np.asarray(values, float), NormalDist()
    if len(v) < 2:
        return float("nan"), float("nan"), "undefined"
    if np.ptp(v) == 0:
        return float(v.mean()), float(v.mean()), "constant"
    rng = np.random.default_rng(seed)
    boot = np.sort(np.concatenate([rng.choice(v, (500, len(v))).mean(axis=1) for _ in range(resamples // 500)]))
    share = float((boot < v.mean()).mean())
    tails = ((1 - level) / 2, (1 + level) / 2)
    if not 0 < share < 1:
        return float(np.quantile(boot, tails[0])), float(np.quantile(boot, tails[1])), "percentile"
    z0 = nd.inv_cdf(share)
    jack = (v.sum() - v) / (len(v) - 1)
    dev = jack.mean() - jack
    spread = (dev**2).sum() ** 1.5
    if spread == 0:
        return float(np.quantile(boot, tails[0])), float(np.quantile(boot, tails[1])), "percentile"
    a, out = (dev**3).sum() / (6 * spread), []
    for q in tails:
        z = z0 + nd.inv_cdf(q)
        out.append(float(np.quantile(boot, nd.cdf(z0 + z / (1 - a * z)))))
    return out[0], out[1], "bca"


def removal_design(centers: DataFrame, cap: int, seed: int) -> DataFrame:
    """(gene, iteration, removed): subset_design() of each gene's centres; a gene with one centre has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for gene, ids in zip(b["gene"], b["ids"]):
                design = subset_design(len(ids), cap, seed)
                yield pd.DataFrame({"gene": [gene] * len(design), "iteration": range(len(design)), "removed": [[int(ids[k]) for k in s] for s in design]})

    ids = centers.groupBy("gene").agg(F.array_sort(F.collect_list(F.col("residue_index").cast("int"))).alias("ids"))
    return ids.mapInPandas(run, "gene string, iteration int, removed array<int>")


def removal_iterations(u: DataFrame, centers: DataFrame, design: DataFrame, radius: float) -> DataFrame:
    """Per gene and removal subset: kept coverage against the whole, and the loss. A residue is lost if all its covering centres are removed."""
    near = sp.range_join(centers, u, radius).groupBy("gene", "point").agg(F.collect_set(F.col("center").cast("int")).alias("centers"))
    kept = design.join(near, "gene").withColumn("kept", F.size(F.array_except("centers", "removed")) > 0)
    g = kept.groupBy("gene", "iteration", F.size("removed").alias("k")).agg(F.count_if("kept").alias("n_kept"), F.count(F.lit(1)).alias("n_all"))
    return g.withColumn("jaccard", F.col("n_kept") / F.col("n_all")).withColumn("dice", 2 * F.col("n_kept") / (F.col("n_kept") + F.col("n_all")))


def containment_iterations(ev: DataFrame, centers: DataFrame, u: DataFrame, design: DataFrame, step: float = 0.5) -> DataFrame:
    """Per gene and removal subset: the containment radius that the frozen evidence set (residues of ev) would have with the centres
    left, and the residue that binds it. Each residue keeps its centres by distance, so an iteration looks for the first left."""
    e = ev.select("gene", "residue_index").join(u.select(*sp.POINT), ["gene", "residue_index"])
    c = centers.select("gene", F.col("residue_index").cast("int").alias("center"), *(F.col(k).alias(f"{k}2") for k in "xyz"))
    order = e.join(c, "gene").select("gene", "residue_index", F.struct(distance().alias("d"), "center").alias("m")).groupBy("gene", "residue_index").agg(F.array_sort(F.collect_list("m")).alias("order"))
    first = F.get(F.filter("order", lambda m: ~F.array_contains(F.col("removed"), m["center"])), F.lit(0))["d"]
    g = design.join(order, "gene").withColumn("d", first).groupBy("gene", "iteration").agg(F.max("d").alias("exact"), F.max_by("residue_index", F.struct("d", -F.col("residue_index"))).alias("binding"))
    return g.withColumn("radius", F.ceil(F.col("exact") / step - 1e-9) * step)


def aggregated(rows: DataFrame, names: list[str], planned: int | None = None, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, metric, n_total, n_valid, mean, sd, cv, q1, median, q3, lowest, highest) of each column; nulls and NaN aren't valid."""
    value = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    each = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), value(n).alias("v")) for n in names))).alias("e")).select(*by, "e.*")
    g = each.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n_total"), F.count("v").alias("n_valid"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), *(F.percentile("v", q).alias(k) for k, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))), F.min("v").alias("lowest"), F.max("v").alias("highest"))
    g = g.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.abs("mean")))
    return g.withColumn("share_of_planned", F.col("n_valid") / F.lit(planned)) if planned else g
