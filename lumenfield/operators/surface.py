"""Surfaces of footprints by marching cubes: area, sphericity, meshes and PLY lines.

A cell's corners are eight neighbouring voxel centres; the field at a corner is the distance to the nearest seed voxel, and the surface is
where it is rho. Only voxels within a cell's diagonal of the surface can be corners of a cell that it cuts, so only those
are dealt to cells. Every gene has a radius and an edge of its own (own_grid), so genes of different edges are one plan.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Corner c of a cell lies at (c & 1, c >> 1 & 1, c >> 2 & 1); an edge joins two corners that differ in one bit, its axis.
EDGES = [(c, c | 1 << axis) for axis in range(3) for c in range(8) if not c >> axis & 1]
#: Voxels of a grid beyond which the coarser edge is taken.
MAX_VOXELS = 100_000_000


def _loops(case: int) -> list[list[int]]:
    """The polygons, as rings of edges, that part a cell's inner corners (the bits of case) from its outer ones.

    On each face the edges that are cut are joined two by two; where all four are, each inner corner is cut off for itself. That
    follows from the face alone, so the cells on its two sides agree.
    """
    links: dict[int, list[int]] = {}
    for axis, side in itertools.product(range(3), (0, 1)):
        face = [c for c in range(8) if c >> axis & 1 == side]
        cut = [e for e, (a, b) in enumerate(EDGES) if a in face and b in face and (case >> a ^ case >> b) & 1]
        if len(cut) == 2:
            joined = [cut]
        else:
            joined = [[e for e in cut if c in EDGES[e]] for c in face if cut and case >> c & 1]
        for a, b in joined:
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
    rings = []
    while links:
        ring = [min(links)]
        while True:
            here = ring[-1]
            ahead = [e for e in links[here] if e not in ring[-2:-1]] if len(ring) > 1 else links[here]
            step = ahead[0]
            if step == ring[0]:
                break
            ring.append(step)
        for e in ring:
            del links[e]
        rings.append(ring)
    return rings


def _outward(ring: list[int], case: int) -> list[int]:
    """The ring, turned so that its normal points from inner to outer corners."""
    at = lambda c: (c & 1, c >> 1 & 1, c >> 2 & 1)
    mid = [[(p + q) / 2 for p, q in zip(at(EDGES[e][0]), at(EDGES[e][1]))] for e in ring]
    normal = [0.0, 0.0, 0.0]
    for p, q in zip(mid, mid[1:] + mid[:1]):
        for k in range(3):
            i, j = (k + 1) % 3, (k + 2) % 3
            normal[k] += p[i] * q[j] - p[j] * q[i]
    out = sum(n * (y - x) * (1 if case >> a & 1 else -1) for a, b in (EDGES[e] for e in ring) for n, x, y in zip(normal, at(a), at(b)))
    return ring if out >= 0 else ring[:1] + ring[:0:-1]


def triangles(case: int) -> list[tuple[int, int, int]]:
    """The triangles, by their edges, of a case: its rings as fans."""
    return [(r[0], r[i], r[i + 1]) for r in (_outward(r, case) for r in _loops(case)) for i in range(1, len(r) - 1)]


def own_grid(centers: DataFrame, radii: DataFrame, h: float = 0.5, coarse: float = 1.0, pad: float = 2.0, most: int = MAX_VOXELS) -> DataFrame:
    """(gene, rho, n_voxels, h, fell_back): each gene's radius (radii: gene, radius), the voxels of the box around its centres, rho and pad
    wide, and its edge: h, or the coarse one where those would be more than ``most``."""
    side = lambda c: F.ceil((F.max(c) - F.min(c) + 2 * (F.first("rho") + pad)) / h) + 1
    g = centers.join(radii.select("gene", F.col("radius").cast("double").alias("rho")), "gene").groupBy("gene", "rho").agg((side("x") * side("y") * side("z")).alias("n_voxels"))
    return g.withColumn("fell_back", F.col("n_voxels") > most).withColumn("h", F.when(F.col("fell_back"), F.lit(coarse)).otherwise(F.lit(h)))


def field(centers: DataFrame, grid: DataFrame, beyond: int = 0, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, rho, h, ix, iy, iz, d2): voxels within rho and ``beyond`` voxels of a seed voxel, d2 the squared distance in voxels; rho and h
    are each gene's own, from own_grid(). by: gene and what else tells sets of centres apart."""
    own = centers.join(F.broadcast(grid.select("gene", "rho", "h")), "gene")
    seeds = own.select(*by, "rho", "h", *(F.floor(F.col(c) / F.col("h") + 1e-9).alias(f"s{c}") for c in "xyz")).distinct()
    reach = F.col("rho") / F.col("h") + beyond
    n = F.floor(reach + 1e-9)
    ball = seeds.withColumn("n", n).withColumn("far", F.floor(reach * reach + 1e-9))
    for c in "xyz":
        ball = ball.withColumn(f"d{c}", F.explode(F.sequence(-F.col("n"), F.col("n"))))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    near = ball.withColumn("d2", d2).where("d2 <= far")
    return near.groupBy(*by, "rho", "h", *((F.col(f"s{c}") + F.col(f"d{c}")).alias(f"i{c}") for c in "xyz")).agg(F.min("d2").alias("d2"))


def inner(v: DataFrame) -> DataFrame:
    """The voxels of a field that are within rho."""
    return v.where(F.col("d2") <= F.floor(F.pow(F.col("rho") / F.col("h"), 2) + 1e-9))


def cells(v: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, rho, h, cx, cy, cz, case, d): the cells that the surface cuts, with the distances of their corners. v: a field() of two voxels beyond rho."""
    d, most = F.sqrt(F.col("d2").cast("double")) * F.col("h"), F.floor(F.pow(F.col("rho") / F.col("h"), 2) + 1e-9)
    shell = v.withColumn("d", d).withColumn("full", F.col("d2") <= most).where(F.abs(F.col("d") - F.col("rho")) <= math.sqrt(3) * F.col("h") + 1e-9)
    corner = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), *(F.lit(c >> k & 1).alias(f"o{a}") for k, a in enumerate("xyz"))) for c in range(8)))).alias("o")
    dealt = shell.select(*by, "rho", "h", "ix", "iy", "iz", "d", "full", corner)
    at = [(F.col(f"i{a}") - F.col(f"o.o{a}")).alias(f"c{a}") for a in "xyz"]
    g = dealt.groupBy(*by, "rho", "h", *at).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("full"), F.expr("shiftleft(1, o.c)")).otherwise(0)).cast("int").alias("case"), *(F.max(F.when(F.col("o.c") == c, F.col("d"))).alias(f"d{c}") for c in range(8))
    )
    return g.where("n = 8 AND case BETWEEN 1 AND 254").select(*by, "rho", "h", "cx", "cy", "cz", "case", F.array(*(F.col(f"d{c}") for c in range(8))).alias("d"))


def triangle_table(spark: SparkSession) -> DataFrame:
    """(case, e): the edges of each triangle of each case."""
    return spark.createDataFrame([(case, list(t)) for case in range(256) for t in triangles(case)], "case int, e array<int>")


def facets(v: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, p, k): the triangles of the surface; p its three corners in space, k what tells them apart (voxel and axis of the edge)."""
    low, high = (F.array(*(F.lit(e[i]) for e in EDGES)) for i in (0, 1))
    cut = cells(v, by).join(F.broadcast(triangle_table(v.sparkSession)), "case")

    def vertex(e: Column) -> Column:
        a, b = F.get(low, e), F.get(high, e)
        da, db = F.get(F.col("d"), a), F.get(F.col("d"), b)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("rho") - da) / (db - da)))
        bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1))
        place = [((F.col(f"c{x}") + bit(a, k) + t * (bit(b, k) - bit(a, k)) + 0.5) * F.col("h")).alias(x) for k, x in enumerate("xyz")]
        key = [(F.col(f"c{x}") + bit(a, k)).alias(f"k{x}") for k, x in enumerate("xyz")]
        return F.struct(F.struct(*place).alias("p"), F.struct(*key, F.floor(e / 4).alias("axis")).alias("k"))

    return cut.select(*by, "rho", F.transform("e", vertex).alias("v")).select(*by, "rho", F.col("v.p").alias("p"), F.col("v.k").alias("k"))


def _area(p: Column) -> Column:
    u, w = ([F.get(p, F.lit(i))[c] - F.get(p, F.lit(0))[c] for c in "xyz"] for i in (1, 2))
    cross = [u[(k + 1) % 3] * w[(k + 2) % 3] - u[(k + 2) % 3] * w[(k + 1) % 3] for k in range(3)]
    return F.sqrt(sum(c * c for c in cross)) / 2


def surface_area(centers: DataFrame, grid: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, rho, h, n_voxels, volume, n_triangles, area, sphericity) of footprints; sphericity (36 pi V^2)^(1/3) / A is 1 for a ball. A set
    without centres has no row."""
    v = field(centers, grid, 2, by)
    size = inner(v).groupBy(*by, "rho", "h").agg(F.count(F.lit(1)).alias("n_voxels"))
    area = facets(v, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_triangles"), F.sum(_area(F.col("p"))).alias("area"))
    volume = F.col("n_voxels") * F.pow("h", F.lit(3))
    g = size.join(area, list(by)).withColumn("volume", volume)
    return g.withColumn("sphericity", F.cbrt(36 * F.pi() * F.col("volume") * F.col("volume")) / F.col("area"))


def mesh(centers: DataFrame, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: gene, id, x, y, z; faces: gene, a, b, c): a gene's surface, each vertex once, ids from 0, normals outwards. Triangles without
    area, two of whose corners coincide, are kept, so every edge has two triangles."""
    f = facets(field(centers, grid, 2))
    each = f.select("gene", F.explode(F.arrays_zip("p", "k")).alias("v")).select("gene", F.col("v.k").alias("k"), F.col("v.p").alias("p"))
    one = each.groupBy("gene", "k").agg(F.first("p").alias("p"))
    number = F.row_number().over(Window.partitionBy("gene").orderBy("k.kx", "k.ky", "k.kz", "k.axis")) - 1
    vertices = one.select("gene", "k", number.cast("long").alias("id"), "p.x", "p.y", "p.z")
    faces = f.select("gene", *(F.col("k")[i].alias(c) for i, c in enumerate("abc")))
    for c in "abc":
        ids = vertices.select("gene", F.col("k").alias(c), F.col("id").alias(f"{c}_id"))
        faces = faces.join(ids, ["gene", c])
    return vertices.drop("k"), faces.select("gene", *(F.col(f"{c}_id").alias(c) for c in "abc"))


def ply_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(gene, part, n, line): the lines of an ASCII PLY file of each gene, in the order of part and n."""
    counts = vertices.groupBy("gene").agg(F.count(F.lit(1)).alias("nv")).join(faces.groupBy("gene").agg(F.count(F.lit(1)).alias("nf")), "gene")
    # The header of the format.
    head = ["ply", "format ascii 1.0", "element vertex {nv}", "property float x", "property float y", "property float z", "element face {nf}", "property list uchar int vertex_indices", "end_header"]
    filled = F.array(*(F.concat(F.lit(x.split("{")[0]), F.col(x[x.index("{") + 1 : -1]).cast("string")) if "{" in x else F.lit(x) for x in head))
    top = counts.select("gene", F.lit(0).alias("part"), F.posexplode(filled).alias("n", "line")).select("gene", "part", F.col("n").cast("long").alias("n"), "line")
    points = vertices.select("gene", F.lit(1), "id", F.concat_ws(" ", *(F.format_string("%.6f", c) for c in "xyz")))
    order = F.row_number().over(Window.partitionBy("gene").orderBy("a", "b", "c")).cast("long")
    return top.union(points).union(faces.select("gene", F.lit(2), order, F.concat_ws(" ", F.lit("3"), "a", "b", "c")))


def write_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """A folder gene=... with one PLY file for each gene."""
    lines = ply_lines(vertices, faces).repartition("gene").sortWithinPartitions("gene", "part", "n")
    lines.select("gene", F.col("line").alias("value")).write.partitionBy("gene").mode("overwrite").text(path)
