"""The driver's tables as tables of this domain: residues in space, a labelled cohort, and raw variant records.

Every table has a ``gene`` column and every operator partitions by it, so many genes run in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BY = ["gene"]
#: Twenty standard amino acids in alphabetical order of their one-letter codes.
LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional universe: gene (of two), residue_index, x, y, z, plddt, is_center (confidence of 50 or more), aa, label."""
    e = table(spark, sf_dir, "embeddings").withColumn("gene", F.concat(F.lit("G"), (F.col("vec_id") % 2 + 1).cast("string")))
    at = F.row_number().over(Window.partitionBy("gene").orderBy("vec_id"))
    axis = lambda i: (F.col("embedding")[i].cast("double") * 100).alias("xyz"[i])
    u = e.select("gene", at.alias("residue_index"), *(axis(i) for i in range(3)), "label")
    aa = F.substring(F.lit(LETTERS), (F.col("residue_index") * 7) % 20 + 1, F.lit(1))
    return u.withColumn("plddt", ((F.col("residue_index") * 37) % 101).cast("double")).withColumn("is_center", F.col("plddt") >= 50).withColumn("aa", aa)


#: Oracles are written for one gene, @GENE@, and run for each (queries.per_gene).
GENES = ["G1", "G2"]
UNIVERSE_SQL = """u0 AS (
  SELECT row_number() OVER (ORDER BY vec_id)::INTEGER AS residue_index, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z, label FROM embeddings WHERE concat('G', vec_id % 2 + 1) = '@GENE@'),
universe AS (SELECT *, ((residue_index * 37) % 101)::DOUBLE AS plddt, ((residue_index * 37) % 101) >= 50 AS is_center, substr('ACDEFGHIKLMNPQRSTVWY', ((residue_index * 7) % 20 + 1)::INTEGER, 1) AS aa FROM u0)"""


def cohort(u: DataFrame, planted: bool = True) -> DataFrame:
    """The labelled residues: universe columns and class, PLP or BLB.

    planted: PLP are the 24 residues nearest residue 1 and every third residue of label 0; BLB are the other residues
    of labels 1 and 2 at a distance of 18 or more from residue 1. Otherwise label 0 is PLP, labels 1 and 2 are BLB.
    """
    if not planted:
        kind = F.when(F.col("label") == 0, "PLP").when(F.col("label").isin(1, 2), "BLB")
        return u.withColumn("class", kind).where("class is not null")
    first = u.where("residue_index = 1").select("gene", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1"))
    d = F.sqrt(F.pow(F.col("x") - F.col("x1"), 2) + F.pow(F.col("y") - F.col("y1"), 2) + F.pow(F.col("z") - F.col("z1"), 2))
    near = F.row_number().over(Window.partitionBy("gene").orderBy("d1", "residue_index"))
    ranked = u.join(F.broadcast(first), "gene").withColumn("d1", d).withColumn("near", near)
    plp = (F.col("near") <= 24) | ((F.col("label") == 0) & (F.col("residue_index") % 3 == 0))
    kind = F.when(plp, "PLP").when(F.col("label").isin(1, 2) & (F.col("d1") >= 18), "BLB")
    return ranked.withColumn("class", kind).where("class is not null").select(*u.columns, "class")


COHORT_SQL = (
    UNIVERSE_SQL
    + """,
c0 AS (SELECT u.*, sqrt((u.x - f.x) ** 2 + (u.y - f.y) ** 2 + (u.z - f.z) ** 2) AS d1 FROM universe u, (SELECT * FROM universe WHERE residue_index = 1) f),
c1 AS (SELECT *, row_number() OVER (ORDER BY d1, residue_index) AS near FROM c0),
c2 AS (SELECT *, CASE WHEN near <= 24 OR (label = 0 AND residue_index % 3 = 0) THEN 'PLP' WHEN label IN (1, 2) AND d1 >= 18 THEN 'BLB' END AS class FROM c1),
cohort AS (SELECT * FROM c2 WHERE class IS NOT NULL)"""
)

#: Raw records by rule from integer keys; the text is valid in Spark SQL and in DuckDB.
RECORDS_SQL = """
SELECT k, CASE WHEN k % 3 = 0 THEN 'G2' ELSE 'G1' END AS gene, concat('CV', CAST(CASE WHEN k % 53 = 0 THEN k - 1 ELSE k END AS STRING)) AS variation_id,
  concat(CASE WHEN k % 29 = 0 THEN '' ELSE concat(CASE WHEN k % 7 = 0 THEN 'NM_900002.1' ELSE 'NM_900001.4' END, '(SYNGENE):c.', CAST(k % 900 + 1 AS STRING), 'A>T ') END,
    CASE WHEN k % 31 = 0 THEN '' ELSE concat('(p.', ref3, CAST(pos AS STRING),
      CASE WHEN k % 17 = 0 THEN 'fs' WHEN k % 19 = 0 THEN 'Ter' WHEN k % 23 = 0 THEN '=' WHEN k % 37 = 0 THEN 'delinsAla' WHEN k % 41 = 0 THEN 'Xaa' ELSE alt3 END, ')') END) AS name,
  CASE k % 13 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Benign' WHEN 2 THEN 'Likely pathogenic' WHEN 3 THEN 'Uncertain significance' WHEN 4 THEN 'Likely benign' WHEN 5 THEN 'Pathogenic, risk factor'
    WHEN 6 THEN 'Conflicting classifications of pathogenicity' WHEN 7 THEN 'Pathogenic; Benign' WHEN 8 THEN 'drug response' WHEN 9 THEN 'Benign/Likely benign' WHEN 10 THEN ' pathogenic/likely  pathogenic ' WHEN 11 THEN '' ELSE 'Likely benign; other' END AS clinical_significance,
  CASE k % 8 WHEN 0 THEN 'practice guideline' WHEN 1 THEN 'reviewed by expert panel' WHEN 2 THEN 'criteria provided, multiple submitters, no conflicts' WHEN 3 THEN 'criteria provided, single submitter'
    WHEN 4 THEN 'no assertion criteria provided' WHEN 5 THEN 'Criteria provided,  single submitter' WHEN 6 THEN 'some new wording' ELSE 'flagged submission' END AS review_status
FROM (SELECT k, pos,
  CASE WHEN (pos * 7 + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) % 20 = 0 THEN 'Ala' ELSE split_part('Ala,Cys,Asp,Glu,Phe,Gly,His,Ile,Lys,Leu,Met,Asn,Pro,Gln,Arg,Ser,Thr,Val,Trp,Tyr', ',', CAST((pos * 7 + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) % 20 + 1 AS INT)) END AS ref3,
  split_part('Ala,Cys,Asp,Glu,Phe,Gly,His,Ile,Lys,Leu,Met,Asn,Pro,Gln,Arg,Ser,Thr,Val,Trp,Tyr', ',', CAST((pos * 7 + 3 + k % 5) % 20 + 1 AS INT)) AS alt3
  FROM (SELECT o_orderkey AS k, CAST((o_orderkey * 13) % 263 + 1 AS INT) AS pos FROM {orders}))
"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a weekly release has them: variation_id, name, clinical_significance and review_status, all text; some ids repeat."""
    return spark.sql(RECORDS_SQL, orders=table(spark, sf_dir, "orders"))


RECORDS_CTE = "records AS (SELECT * FROM (" + RECORDS_SQL.replace("{orders}", "orders").replace("AS STRING", "AS VARCHAR") + ") WHERE gene = '@GENE@')"
