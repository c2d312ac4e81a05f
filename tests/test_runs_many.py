import json
import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lumenfield.functions import subsets as ss
from lumenfield.operators import surface as sf
from lumenfield.plans import batch, checks, runs
from lumenfield.sources import voxel_store as vs

POINTS = "gene string, residue_index int, x double, y double, z double"


def test_voxels_come_back_and_are_made_again(spark, tmp_path):
    c = spark.createDataFrame([("G", 1, -1.0, 0.3, 7.9), ("G", 2, 3.0, 1.0, 0.0), ("H", 1, 0.0, 0.0, 0.0)], POINTS)
    grid = spark.createDataFrame([("G", 2.5, 0.5), ("H", 3.0, 1.0)], "gene string, rho double, h double")
    v = sf.inner(sf.field(c, grid)).select("gene", "ix", "iy", "iz")
    path = str(tmp_path / "v")
    vs.write_voxels(v, c, grid, path)
    want = sorted(map(tuple, v.collect()))
    assert sorted(map(tuple, vs.unpack(vs.read_blocks(spark, path)).collect())) == want
    assert sorted(map(tuple, vs.regenerated(spark, path).collect())) == want
    assert {r.gene: r.n_different for r in vs.verified(spark, path).collect()} == {"G": 0, "H": 0}
    one = vs.read_blocks(spark, path, ["H"])
    assert "PartitionFilters: [isnotnull(gene" in one._jdf.queryExecution().toString() or "PartitionFilters: [gene" in one._jdf.queryExecution().toString()
    assert {r.gene for r in one.collect()} == {"H"} and sum(r.n for r in one.collect()) == sum(g == "H" for g, *_ in want)
    # a block that was changed is found
    bad = vs.read_blocks(spark, path).withColumn("words", F.when((F.col("gene") == "H") & (F.col("bx") == 0) & (F.col("by") == 0) & (F.col("bz") == 0), F.transform("words", lambda w, i: F.when(i == 0, F.lit(5).cast("long")).otherwise(w))).otherwise(F.col("words")))
    bad.write.partitionBy("gene").parquet(str(tmp_path / "w/blocks"))
    spark.read.parquet(f"{path}/recipe").write.partitionBy("gene").parquet(str(tmp_path / "w/recipe"))
    assert {r.gene: r.n_different for r in vs.verified(spark, str(tmp_path / "w")).collect()} == {"G": 0, "H": 1}


def test_places_of_subsets(spark):
    rows = [(n, list(s), i) for n, k in ((5, 2), (6, 6), (7, 1), (6, 3)) for i, s in enumerate(combinations(range(n), k))]
    df = spark.createDataFrame(rows, "n int, s array<int>, i long").withColumn("t", ss.binomials(F.col("n")))
    for r in df.select("i", "s", ss.rank(F.col("s"), F.col("n"), F.col("t")).alias("r"), ss.unrank(F.col("i"), F.col("n"), F.size("s"), F.col("t")).alias("u")).collect():
        assert r.r == r.i and r.u == r.s
    big = spark.createDataFrame([(60, 30, "118264581564861423"), (60, 30, "77"), (126, 63, str(math.comb(126, 63) - 1)), (60, 30, "118264581564861424"), (60, 30, "-1")], "n int, k int, p string")
    big = big.withColumn("p", F.col("p").cast(ss.WIDE)).withColumn("t", ss.binomials(F.col("n"))).withColumn("s", ss.unrank(F.col("p"), F.col("n"), F.col("k"), F.col("t")))
    got = big.select("p", "s", ss.rank(F.col("s"), F.col("n"), F.col("t")).alias("r")).collect()
    assert [x.r for x in got[:3]] == [x.p for x in got[:3]] and got[0].s == list(range(30, 60)) and got[3].s is None and got[4].s is None
    with pytest.raises(Exception, match="no exact place"):
        spark.range(1).select(ss.binomials(F.lit(127) + F.col("id").cast("int"))).collect()


def test_checks_are_made_by_the_write(spark, tmp_path):
    path, df = str(tmp_path), spark.createDataFrame([("G", 1, 0.5), ("G", 2, None)], "gene string, i int, p double")
    rules = {"p is a probability": F.col("p").between(0, 1), "gene is named": F.col("gene") != ""}
    with pytest.raises(checks.Broken) as e:
        checks.write_checked(df, path, "bad", rules, rows=3)
    assert e.value.problems == ["bad: p is a probability is broken by 1 of 2 rows", "bad: rows is broken by 1 of 2 rows"]
    with pytest.raises(checks.Broken):
        checks.read_checked(spark, path, "bad")
    with pytest.raises(checks.Broken, match="not checked"):
        checks.read_checked(spark, path, "never")
    verdicts = checks.write_checked(df.where("i = 1"), path, "good", rules, rows=1).collect()
    assert all(v.holds for v in verdicts) and checks.read_checked(spark, path, "good").count() == 1


def test_broken_handoffs_are_refused(spark, tmp_path):
    config = runs.configured()
    result = runs.Result("COMPLETED", {"t": spark.createDataFrame([("G", 1)], "gene string, i int")}, {"radius": {"G": 9.5}})
    path = str(tmp_path / "run")
    runs.write_run(result, path, config, runs.run_id(config, "abcdef01"))
    h = checks.load_handoff(spark, path, config)
    assert h["state"] == "COMPLETED"

    def broken(change, match, raw=None):
        x = {**h, **change}
        text = raw if raw is not None else json.dumps({k: v for k, v in x.items() if v != "gone"})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/handoff")
        with pytest.raises(checks.Broken, match=match):
            checks.load_handoff(spark, path, config)

    broken({"run_id": "gone"}, "missing: run_id")
    broken({"state": "ODD"}, "unknown state")
    broken({"exit_code": 3}, "does not end with 3")
    broken({"config_sha256": "0"}, "another configuration")
    broken({"tables": ["t", "u"]}, "u: is not there")
    broken({}, "no JSON", raw="{")
    broken({}, "no JSON object", raw="[1]")
    with pytest.raises(checks.Broken):
        checks.write_checked(spark.createDataFrame([("G", 1)], "gene string, i int"), path, "t", {"i is 2": F.col("i") == 2})
    broken({}, "i is 2 is broken")


def test_newest_run_of_each_gene(spark):
    text = lambda run, state, radius, **more: json.dumps({"run_id": run, "state": state, "facts": {"radius": radius, **more}, "warnings": ["w"], **more})
    rows = [text("20250101T000000Z_a", "COMPLETED", {"G": 8, "H": 7.5}), text("20260101T000000Z_b", "BLOCKED", {"G": 9.5}, extra={"deep": [1]}), "no json", "[]", json.dumps({"run_id": "20270101T000000Z_c", "state": "FAILED", "facts": {}}), json.dumps({"facts": {"radius": {"K": 1}}}), None]
    got = {r.gene: r for r in batch.newest_by_gene(spark.createDataFrame([(r,) for r in rows], "value string")).collect()}
    assert {g: (r.run_id, r.state, r.radius, r.warnings) for g, r in got.items()} == {"G": ("20260101T000000Z_b", "BLOCKED", 9.5, ["w"]), "H": ("20250101T000000Z_a", "COMPLETED", 7.5, ["w"])}


def test_all_regimes(spark):
    names = ["state", "stop_reason", "n_p", "n_centers", "footprint_radius", "coverage", "fold_enrichment", "jaccard_median", "binding_is_outlier"]
    kinds = "state string, stop_reason string, n_p int, n_centers int, footprint_radius double, coverage double, fold_enrichment double, jaccard_median double, binding_is_outlier boolean"
    rows = {
        ("FAILED", "no model", None, None, None, None, None, None, None): ("input_limited", "", "no usable inputs: no model"),
        ("UNDERPOWERED", None, 4, 0, None, None, None, None, None): ("cannot_be_asked", "", None),
        ("COMPLETED_NEGATIVE", "INSUFFICIENT", 9, 0, None, None, None, None, None): ("input_limited", "", "one class of the cohort is empty"),
        ("COMPLETED_NEGATIVE", "NONE", 9, None, None, None, None, None, None): ("no_spatial_concentration", "", None),
        ("COMPLETED", "NO_ADMISSIBLE_FOOTPRINT", 9, 3, None, None, None, None, None): ("refused_degenerate", "", None),
        ("BLOCKED", None, 9, 3, None, 0.8, 1.0, None, None): ("diffuse_no_localised_region", "", None),
        ("COMPLETED", None, 9, 3, 8.0, 0.1, 2.0, 0.95, False): ("works", "A", "meets all four criteria"),
        ("COMPLETED", None, 9, 3, 8.0, 0.1, 1.2, 0.8, None): ("works", "C", "weak enrichment (1.20); moderate stability (Jaccard 0.800)"),
        ("COMPLETED", None, 9, 3, 8.0, 0.4, 1.0, 0.5, True): ("works_with_caveat", "D", "no enrichment over the labelled background; fragile under loss of centres (Jaccard 0.500); the radius rests on one outlying residue; the footprint covers 0.400 of the structure"),
        ("COMPLETED", None, 9, 3, 8.0, None, None, None, None): ("works_with_caveat", "D", "meets all four criteria"),
    }
    got = batch.classified(spark.createDataFrame(list(rows), kinds)).collect()
    for r in got:
        want = rows[tuple(r[n] for n in names)]
        assert (r.regime, r.tier) == want[:2] and (want[2] is None or r.caveat == want[2])
