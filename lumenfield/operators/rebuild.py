"""Robustness under removal: each iteration's footprint is built anew at the frozen radius and held against the whole one.

A gene's iterations are dealt to tasks in blocks, each with the gene's centres and residues. In a block the field is a box of squared
distances; an iteration stamps the ball of each centre left into it and reads volume and surface from it. Balls are connected, so
components are those of the graph of centres whose balls meet, and a residue is covered if a centre left covers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st
from .surface import EDGES, triangles

#: Iterations of a block.
BLOCK = 200
FAMILIES = {"footprint": "fp_", "hotspot": "hot_"}
GEOMETRY = [
    "jaccard_residues", "dice_residues", "jaccard_voxels", "dice_voxels", "n_footprint_residues", "coverage_fraction", "volume", "volume_ratio", "volume_delta", "surface_area", "surface_ratio",
    "n_components", "component_preserved", "continuity", "centroid_shift", "hausdorff95",
]
COUNTS = [f"{p}{c}" for p in FAMILIES.values() for c in ("tp", "fp", "tn", "fn")]

_SIZES = np.array([len(triangles(case)) for case in range(256)])
_FIRST = np.cumsum(_SIZES) - _SIZES
_TRIANGLES = np.array([t for case in range(256) for t in triangles(case)])
_CORNERS = np.array([(c & 1, c >> 1 & 1, c >> 2 & 1) for c in range(8)])
_LOW, _HIGH = np.array(EDGES).T
_PLACE, _ALONG = _CORNERS[_LOW].astype(float), (_CORNERS[_HIGH] - _CORNERS[_LOW]).astype(float)


class Surface:
    """Areas of the surfaces of boxes of one shape, of squared distances in voxels; those up to ``most`` are inside, and the border, two
    voxels wide, is outside.

    A cell whose corners have the distances that they have in the first box has its area too, and that is looked up.
    """

    def __init__(self, first: np.ndarray, most: int, rho: float, h: float):
        self.first, self.most, self.rho, self.h = first.ravel().copy(), most, rho, h
        self.step = (_CORNERS * [first.shape[1] * first.shape[2], first.shape[2], 1]).sum(axis=1)
        self.of_first = np.zeros(len(self.first))
        at, corner = self._cut(self.first)
        self.of_first[at] = self._areas(self.first[corner])

    def _cut(self, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells that the surface cuts, by their first corner; their corners), as places in the flat box."""
        full = (d2 <= self.most).view(np.uint8)
        n = len(full) - self.step[-1]  # cells over the border's edge have only outer corners
        case = full[:n].copy()
        for c in range(1, 8):
            case |= full[self.step[c] : self.step[c] + n] << np.uint8(c)
        at = np.flatnonzero((case - np.uint8(1)) < np.uint8(254))
        return at, at[:, None] + self.step[None]

    def _areas(self, d2: np.ndarray) -> np.ndarray:
        """The area in each cell, from its corners' squared distances."""
        kind = ((d2 <= self.most) << np.arange(8)).sum(axis=1)
        n = _SIZES[kind]
        row = np.repeat(np.arange(len(d2)), n)
        edge = _TRIANGLES[np.repeat(_FIRST[kind] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        d = (np.sqrt(d2.astype(np.float64)) * self.h).ravel()
        a, b = d[8 * row[:, None] + _LOW[edge]], d[8 * row[:, None] + _HIGH[edge]]
        t = np.clip((self.rho - a) / (b - a), 0, 1)
        p = _PLACE[edge].transpose(2, 0, 1) + t * _ALONG[edge].transpose(2, 0, 1)
        u, w = p[:, :, 1] - p[:, :, 0], p[:, :, 2] - p[:, :, 0]
        cross = [u[(k + 1) % 3] * w[(k + 2) % 3] - u[(k + 2) % 3] * w[(k + 1) % 3] for k in range(3)]
        return np.bincount(row, np.sqrt(cross[0] ** 2 + cross[1] ** 2 + cross[2] ** 2) / 2 * self.h**2, len(d2))

    def area(self, box: np.ndarray) -> float:
        d2 = box.ravel()
        at, corner = self._cut(d2)
        own = d2[corner]
        new = (own != self.first[corner]).any(axis=1)
        return float(self.of_first[at[~new]].sum() + self._areas(own[new]).sum())


def _meet(seeds: np.ndarray, reach: float) -> np.ndarray:
    """Which centres' balls share a voxel or have face neighbours."""
    n, far = int(reach + 1e-9), int(reach * reach + 1e-9)
    axis = np.arange(-n, n + 1)
    ball = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3)
    ball = ball[(ball**2).sum(axis=1) <= far]
    steps = np.concatenate([np.zeros((1, 3), int), np.eye(3, dtype=int), -np.eye(3, dtype=int)])
    out = np.eye(len(seeds), dtype=bool)
    for i in range(len(seeds)):
        for j in range(i):
            apart = seeds[j] - seeds[i]
            length = np.sqrt((apart**2).sum())
            if length <= 2 * reach - 2:  # the voxel nearest the middle is in both
                out[i, j] = out[j, i] = True
            elif length <= 2 * reach + 1:
                out[i, j] = out[j, i] = any(((ball + s - apart) ** 2).sum(axis=1).min() <= far for s in steps)
    return out


def _count_groups(meet: np.ndarray) -> int:
    left, n = np.ones(len(meet), bool), 0
    while left.any():
        now = np.zeros(len(meet), bool)
        now[np.argmax(left)] = True
        while True:
            more = meet[now].any(axis=0) | now
            if (more == now).all():
                break
            now = more
        left &= ~now
        n += 1
    return n


class Footprint:
    """A gene's centres and residues, of which parts are left."""

    def __init__(self, centers: np.ndarray, residues: np.ndarray, kind: np.ndarray, total: int, rho: float, h: float, r_hot: float):
        """centers, residues: coordinates; kind: 1 for P/LP, -1 for B/LB, 0 for other residues; total: residues of the gene."""
        self.rho, self.h, self.total = rho, h, total
        seeds = np.floor(centers / h + 1e-9).astype(int)
        reach = rho / h
        n = int(reach + 2 + 1e-9)
        self.most = int(reach * reach + 1e-9)
        axis = np.arange(-n, n + 1) ** 2
        self.ball = np.minimum(axis[:, None, None] + axis[None, :, None] + axis[None, None, :], 65_000).astype(np.uint16)
        self.low = seeds - seeds.min(axis=0)
        self.box = np.empty(tuple(self.low.max(axis=0) + 2 * n + 1), np.uint16)
        self.meet = _meet(seeds, reach)
        d = np.sqrt(((residues[:, None, :] - centers[None]) ** 2).sum(axis=2))
        self.covers, self.hot = d <= rho, d <= r_hot
        self.residues, self.kind = residues, kind
        covered = self.covers.any(axis=1)
        self.of = np.flatnonzero(covered)
        p = residues[self.of]
        self.between = np.sqrt(((p[:, None, :] - p[None]) ** 2).sum(axis=2))
        every = np.ones(len(centers), bool)
        self.surface = Surface(self._stamped(every), self.most, rho, h)
        self.whole = self._built(every)

    def _stamped(self, left: np.ndarray) -> np.ndarray:
        box, side = self.box, len(self.ball)
        box.fill(65_535)
        for x, y, z in self.low[left]:
            part = box[x : x + side, y : y + side, z : z + side]
            np.minimum(part, self.ball, out=part)
        return box

    def _built(self, left: np.ndarray) -> tuple[int, float, int, np.ndarray]:
        """(voxels, area, components, covered residues) of the centres left."""
        if not left.any():
            return 0, float("nan"), 0, np.zeros(len(self.residues), bool)
        box = self._stamped(left)
        return int(np.count_nonzero(box <= self.most)), self.surface.area(box), _count_groups(self.meet[np.ix_(left, left)]), self.covers[:, left].any(axis=1)

    def _confusion(self, inside: np.ndarray) -> list[int]:
        return [int((inside & (self.kind == 1)).sum()), int((inside & (self.kind == -1)).sum()), int((~inside & (self.kind == -1)).sum()), int((~inside & (self.kind == 1)).sum())]

    def compared(self, left: np.ndarray) -> list[float]:
        """GEOMETRY and COUNTS of the centres left, against all."""
        n0, area0, groups0, all_ = self.whole
        n, area, groups, covered = self._built(left)
        r0, r, voxel = int(all_.sum()), int(covered.sum()), self.h**3
        over = lambda a, b: a / b if b > 0 else float("nan")
        shift = far = float("nan")
        if r and r0:
            shift = float(np.linalg.norm(self.residues[covered].mean(axis=0) - self.residues[all_].mean(axis=0)))
            # what is left is part of the whole, so only the way from the whole to it has a length
            far = float(np.quantile(self.between[:, covered[self.of]].min(axis=1), 0.95))
        share = lambda a, b: a / b if b else 0.0
        geometry = [
            share(r, r0), share(2 * r, r + r0), share(n, n0), share(2 * n, n + n0), r, r / self.total, n * voxel, over(n, n0), (n - n0) * voxel, area, over(area, area0),
            groups, float(groups == groups0), float(r > 0), shift, far,
        ]
        return geometry + self._confusion(covered) + self._confusion(self.hot[:, left].any(axis=1))


def rebuilt(u: DataFrame, labelled: DataFrame, centers: DataFrame, design: DataFrame, grid: DataFrame, r_hot: float) -> DataFrame:
    """(gene, iteration, k, GEOMETRY, COUNTS): for each removal of design (gene, iteration, removed) the footprint of the centres left, at the gene's own
    radius and edge (grid: gene, rho, h), against the footprint of all.

    fp_ counts judge labelled residues by the footprint, hot_ counts by the reach r_hot of the centres left. Empty footprints have Jaccard and
    Dice 0, and NaN for what isn't defined. Genes without removals have no rows.
    """
    point = lambda *more: F.struct("residue_index", "x", "y", "z", *more)
    c = centers.groupBy("gene").agg(F.array_sort(F.collect_list(point())).alias("centers"))
    kind = F.when(F.col("class") == "PLP", 1).when(F.col("class") == "BLB", -1).otherwise(0).alias("kind")
    near = u.join(labelled.select("gene", "residue_index", "class"), ["gene", "residue_index"], "left").groupBy("gene").agg(F.array_sort(F.collect_list(point(kind))).alias("residues"))
    blocks = design.withColumn("block", F.floor(F.col("iteration") / BLOCK)).groupBy("gene", "block").agg(F.collect_list(F.struct("iteration", "removed")).alias("removals"))
    # a row for each block, with the gene's points: a few hundred thousand bytes of them at most
    tasks = blocks.join(c, "gene").join(near, "gene").join(grid.select("gene", "rho", "h"), "gene")
    # a number of partitions, as the rows are small and their work isn't: left to itself, the runtime would put them into one
    tasks = tasks.repartition(4 * int(u.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gene", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids = np.array([p["residue_index"] for p in r.centers])
                xyz = lambda points: np.array([[p["x"], p["y"], p["z"]] for p in points], float).reshape(-1, 3)
                fp = Footprint(xyz(r.centers), xyz(r.residues), np.array([p["kind"] for p in r.residues]), len(r.residues), r.rho, r.h, r_hot)
                rows = [[r.gene, int(x["iteration"]), len(x["removed"]), *fp.compared(~np.isin(ids, x["removed"]))] for x in r.removals]
                yield pd.DataFrame(rows, columns=["gene", "iteration", "k", *GEOMETRY, *COUNTS])

    kinds = dict.fromkeys(GEOMETRY, "double") | dict.fromkeys(COUNTS, "long")
    out = tasks.mapInPandas(run, "gene string, iteration int, k int, " + ", ".join(f"{n} {t}" for n, t in kinds.items()))
    nan = ("volume_ratio", "surface_area", "surface_ratio", "centroid_shift", "hausdorff95")  # pandas hands NaN over as null
    whole = [F.col(n).cast("long").alias(n) for n in ("n_footprint_residues", "n_components")] + [(F.col(n) > 0).alias(n) for n in ("component_preserved", "continuity")]
    fixed = {c: e for c, e in zip(("n_footprint_residues", "n_components", "component_preserved", "continuity"), whole)} | {n: F.coalesce(n, F.lit(float("nan"))).alias(n) for n in nan}
    return out.select(*(fixed.get(c, F.col(c)) for c in out.columns))


def with_rates(rows: DataFrame) -> DataFrame:
    """rows of rebuilt() with the classification metrics of both families, under their prefixes."""
    rates = [m.alias(f"{p}{k}") for p in FAMILIES.values() for k, m in st.rates(*(F.col(f"{p}{c}") for c in ("tp", "fp", "tn", "fn"))).items()]
    return rows.select("*", *rates)
