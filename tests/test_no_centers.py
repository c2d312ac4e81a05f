"""Summaries of genes without a significant centre."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfield import queries as q

from test_queries import rows


@pytest.fixture(scope="module")
def bare(spark, small, tmp_path_factory):
    """Thirty positions of each gene, of which 24 and more are P/LP: no centre can be significant."""
    d = str(tmp_path_factory.mktemp("bare"))
    spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 60").withColumn("label", F.lit(2).cast("int")).coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["preservation", "robustness_profile", "voxel_surface"])
def test_genes_without_centers_have_rows(spark, bare, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{bare}/embeddings.parquet/*.parquet'")
    assert q.QUERIES["hotspot_regions"](spark, bare).count() == 0
    df = q.QUERIES[name](spark, bare)
    r = c.execute(q.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in r.description], r.fetchall())
