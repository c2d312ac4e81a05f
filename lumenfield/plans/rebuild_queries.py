"""Queries over surfaces and over footprints that are built anew: at the gene's containment radius, on its own grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import subsets as ss
from ..operators import footprint as fp
from ..operators import rebuild as rb
from ..operators import surface as sf
from ..queries import query
from ..sources import voxel_store as vs
from .decision_queries import _regions
from .footprint_queries import EVIDENCE
from .spatial_queries import R

REMOVALS, DESIGN_SEED = 10_000, 20250101


def _footprints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(universe, cohort, significant centres, grid) with the containment radius of each gene's evidence as rho."""
    u, c, centers, _ = _regions(spark, sf_dir)
    radii = fp.containment(fp.evidence(c, centers), R).select("gene", "radius")
    return u, c, centers, sf.own_grid(centers, radii)


_BIT = lambda c, k: f"(({c} >> {k}) & 1)"
_AT = lambda e, k, x: f"((c{x} + {_BIT(f'{e}.p', k)} + greatest(0, least(1, (rho - d[{e}.p + 1]) / (d[{e}.q + 1] - d[{e}.p + 1]))) * ({_BIT(f'{e}.q', k)} - {_BIT(f'{e}.p', k)}) + 0.5::DOUBLE) * h)"
_SIDE = lambda x: f"(ceil((max({x}) - min({x}) + 2 * (any_value(rho) + 2)) / 0.5::DOUBLE) + 1)"
GRID = f"""{EVIDENCE}, rd AS (SELECT ceil(exact / 0.5::DOUBLE) * 0.5::DOUBLE AS rho FROM fe WHERE n_in > 0),
bx AS (SELECT any_value(rho) AS rho, CASE WHEN {' * '.join(map(_SIDE, 'xyz'))} > {sf.MAX_VOXELS} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS h FROM sc, rd HAVING count(*) > 0)"""
CELLS = f"""{GRID}, sd AS (SELECT DISTINCT floor(x / h + 1e-9)::BIGINT AS sx, floor(y / h + 1e-9)::BIGINT AS sy, floor(z / h + 1e-9)::BIGINT AS sz FROM sc, bx),
ax AS (SELECT unnest(range(-n, n + 1)) AS o FROM (SELECT floor(rho / h + 2 + 1e-9)::BIGINT AS n FROM bx)),
bl AS (SELECT a.o AS dx, b.o AS dy, c.o AS dz, a.o * a.o + b.o * b.o + c.o * c.o AS d2 FROM ax a, ax b, ax c, bx WHERE a.o * a.o + b.o * b.o + c.o * c.o <= (rho / h + 2) ** 2 + 1e-9::DOUBLE),
vx AS (SELECT sx + dx AS ix, sy + dy AS iy, sz + dz AS iz, min(d2) AS d2 FROM sd, bl GROUP BY ALL),
sh AS (SELECT *, sqrt(d2) * h AS d, d2 <= floor((rho / h) ** 2 + 1e-9::DOUBLE) AS inside FROM vx, bx WHERE abs(sqrt(d2) * h - rho) <= sqrt(3) * h + 1e-9::DOUBLE),
cl AS (SELECT ix - {_BIT('c', 0)} AS cx, iy - {_BIT('c', 1)} AS cy, iz - {_BIT('c', 2)} AS cz, sum(CASE WHEN inside THEN 1 << c ELSE 0 END)::INTEGER AS kind, list(d ORDER BY c) AS d FROM sh, (SELECT unnest(range(8))::INTEGER AS c) GROUP BY 1, 2, 3 HAVING count(*) = 8),
eg(e, p, q) AS (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(sf.EDGES))}),
tr(kind, e0, e1, e2) AS (VALUES {', '.join(f'({case}, {a}, {b}, {c})' for case in range(256) for a, b, c in sf.triangles(case))}),
tv AS (SELECT {', '.join(f'{_AT(f"v{i}", k, x)} AS {x}{i}' for i in range(3) for k, x in enumerate('xyz'))} FROM cl JOIN tr USING (kind) JOIN eg v0 ON v0.e = e0 JOIN eg v1 ON v1.e = e1 JOIN eg v2 ON v2.e = e2, bx),
ar AS (SELECT count(*) AS n_triangles, sum(sqrt(((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0)) ** 2 + ((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0)) ** 2 + ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) ** 2) / 2) AS area FROM tv),
vo AS (SELECT count(*) AS n_voxels, count(*) * any_value(h) ** 3 AS volume FROM vx, bx WHERE d2 <= floor((rho / h) ** 2 + 1e-9::DOUBLE))"""


@query(f"WITH RECURSIVE {CELLS} SELECT rho, h, n_voxels, round(volume, 6) AS volume, n_triangles, round(area, 4) AS area, round(cbrt(36 * pi() * volume * volume) / area, 6) AS sphericity FROM bx, vo, ar")
def footprint_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, marching-cubes area and sphericity at the containment radius."""
    _, _, centers, grid = _footprints(spark, sf_dir)
    s = sf.surface_area(centers, grid)
    return s.select("gene", "rho", "h", "n_voxels", F.round("volume", 6).alias("volume"), "n_triangles", F.round("area", 4).alias("area"), F.round("sphericity", 6).alias("sphericity"))


@query()
def footprint_ply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each gene's mesh file."""
    _, _, centers, grid = _footprints(spark, sf_dir)
    return sf.ply_lines(*sf.mesh(centers, grid)).select("gene", "part", "n", "line")


@query(f"WITH RECURSIVE {GRID} SELECT rho, h, ({' * '.join(map(_SIDE, 'xyz'))})::BIGINT AS n_voxels FROM sc, bx GROUP BY rho, h")
def footprint_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius, edge and voxels of each gene's grid."""
    return _footprints(spark, sf_dir)[3].select("gene", "rho", "h", F.col("n_voxels").cast("long").alias("n_voxels"))


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c, centers, grid = _footprints(spark, sf_dir)
    return rb.rebuilt(u, c, centers, fp.removal_design(centers, REMOVALS, DESIGN_SEED), grid, R)


@query()
def iteration_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen comparisons of each removal's footprint, rebuilt at the frozen radius, with the whole one."""
    whole = ("n_footprint_residues", "n_components", "component_preserved", "continuity")
    return _rebuilt(spark, sf_dir).select("gene", "iteration", "k", *(F.col(n) if n in whole else F.round(n, 6).alias(n) for n in rb.GEOMETRY))


@query()
def robustness_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution over all removals of every metric of three families: geometry, and classification by footprint and by hotspot."""
    rows = rb.with_rates(_rebuilt(spark, sf_dir))
    rates = [f"{p}{k}" for p in rb.FAMILIES.values() for k in st.rates(*(F.lit(1),) * 4)]
    flags = {n: F.col(n).cast("double") for n in ("component_preserved", "continuity")}
    a = fp.aggregated(rows.withColumns(flags), [*rb.GEOMETRY, *rates])
    family = F.when(F.col("metric").startswith("fp_"), "footprint").when(F.col("metric").startswith("hot_"), "hotspot").otherwise("geometry")
    return a.select("gene", family.alias("family"), "metric", "n_total", "n_valid", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "cv", "q1", "median", "q3", "lowest", "highest")))


@query(f"WITH RECURSIVE {CELLS} SELECT ix >> 3 AS bx, iy >> 3 AS by, iz >> 3 AS bz, count(*) AS n FROM vx, bx WHERE d2 <= floor((rho / h) ** 2 + 1e-9::DOUBLE) GROUP BY 1, 2, 3")
def voxel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gene's footprint as bit-packed blocks: the voxels that unpacking them gives, by block."""
    _, _, centers, grid = _footprints(spark, sf_dir)
    v = vs.unpack(vs.pack(sf.inner(sf.field(centers, grid))))
    return v.groupBy("gene", *(F.floor(F.col(f"i{c}") / vs.SIDE).alias(f"b{c}") for c in "xyz")).agg(F.count(F.lit(1)).alias("n"))


@query()
def removal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each removal among all of its size, and whether the place leads back to it."""
    _, _, centers, _ = _footprints(spark, sf_dir)
    ids = centers.groupBy("gene").agg(F.array_sort(F.collect_list(F.col("residue_index").cast("int"))).alias("ids")).withColumn("n", F.size("ids"))
    ids = ids.where(F.col("n") <= ss.MOST).withColumn("table", ss.binomials(F.col("n")))
    d = fp.removal_design(centers, REMOVALS, DESIGN_SEED).join(ids, "gene")
    d = d.withColumn("subset", F.transform("removed", lambda r: (F.array_position("ids", r) - 1).cast("int")))
    d = d.withColumn("place", ss.rank(F.col("subset"), F.col("n"), F.col("table")))
    back = ss.unrank(F.col("place"), F.col("n"), F.size("subset"), F.col("table"))
    return d.select("gene", "iteration", F.size("subset").alias("k"), F.col("place").cast("string").alias("place"), back.eqNullSafe(F.col("subset")).alias("leads_back"))
