"""Occupied voxels as bit-packed blocks, with the recipe that makes them again.

A block is 8 x 8 x 8 voxels: its place, how many are occupied, and their bits in eight longs. Blocks lie in Parquet, partitioned by gene, so a
reader of one gene opens its files alone, a write is published whole by Spark's committer, and any store that Spark reaches will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.surface import field, inner

SIDE, WORDS = 8, 8


def pack(v: DataFrame) -> DataFrame:
    """(gene, bx, by, bz, n, words) of voxels (gene, ix, iy, iz; each once). Places may be negative."""
    low = lambda c: F.col(f"i{c}").cast("long").bitwiseAND(F.lit(SIDE - 1))
    bit = (low("x") * SIDE + low("y")) * SIDE + low("z")
    rows = v.select("gene", *(F.shiftright(F.col(f"i{c}").cast("long"), 3).alias(f"b{c}") for c in "xyz"), F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), bit.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    mark = lambda k: F.bit_or(F.when(F.col("word") == k, F.expr("shiftleft(one, at)")).otherwise(F.lit(0).cast("long")))
    return rows.groupBy("gene", "bx", "by", "bz").agg(F.count(F.lit(1)).alias("n"), *(mark(k).alias(f"w{k}") for k in range(WORDS))).select("gene", "bx", "by", "bz", "n", F.array(*(F.col(f"w{k}") for k in range(WORDS))).alias("words"))


def unpack(blocks: DataFrame) -> DataFrame:
    """The voxels of pack()."""
    each = blocks.select("gene", "bx", "by", "bz", F.posexplode("words").alias("word", "bits")).where("bits <> 0")
    each = each.select("gene", "bx", "by", "bz", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at")).where("shiftright(bits, at) & 1 = 1")
    bit = F.col("word") * 64 + F.col("at")
    place = [(F.col(f"b{c}") * SIDE + F.shiftright(bit, s).bitwiseAND(F.lit(SIDE - 1))).alias(f"i{c}") for c, s in (("x", 6), ("y", 3), ("z", 0))]
    return each.select("gene", *place)


def write_voxels(v: DataFrame, centers: DataFrame, grid: DataFrame, path: str) -> None:
    """Blocks of v, and the recipe: the centres (gene, residue_index, x, y, z) with each gene's radius and edge (grid: gene, rho, h)."""
    pack(v).repartition("gene").sortWithinPartitions("gene", "bx", "by", "bz").write.partitionBy("gene").mode("overwrite").parquet(f"{path}/blocks")
    recipe = centers.select("gene", "residue_index", "x", "y", "z").join(grid.select("gene", "rho", "h"), "gene")
    recipe.repartition("gene").sortWithinPartitions("gene", "residue_index").write.partitionBy("gene").mode("overwrite").parquet(f"{path}/recipe")


def _read(spark: SparkSession, path: str, genes: list[str] | None, schema: str) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    return df if genes is None else df.where(F.col("gene").isin(genes))


def read_blocks(spark: SparkSession, path: str, genes: list[str] | None = None) -> DataFrame:
    return _read(spark, f"{path}/blocks", genes, "bx long, by long, bz long, n long, words array<long>, gene string").select("gene", "bx", "by", "bz", "n", "words")


def regenerated(spark: SparkSession, path: str, genes: list[str] | None = None) -> DataFrame:
    """The voxels that the recipe gives."""
    r = _read(spark, f"{path}/recipe", genes, "residue_index long, x double, y double, z double, rho double, h double, gene string")
    return inner(field(r.drop("rho", "h"), r.select("gene", "rho", "h").distinct())).select("gene", "ix", "iy", "iz")


def verified(spark: SparkSession, path: str, genes: list[str] | None = None) -> DataFrame:
    """(gene, n_blocks, n_voxels, n_different): of each gene the blocks that are stored, or that the recipe gives, and those in which the two differ."""
    stored, made = read_blocks(spark, path, genes), pack(regenerated(spark, path, genes))
    key = ["gene", "bx", "by", "bz"]
    both = stored.join(made.select(*key, F.col("words").alias("again")), key, "full_outer")
    return both.groupBy("gene").agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_voxels"), F.count_if(~F.col("words").eqNullSafe(F.col("again"))).alias("n_different"))
