"""Whole runs: configuration, identity, stages from records to regions, terminal state, manifest and handoffs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import footprint as fp
from ..operators import nulls as nu
from ..operators import regions as rg
from ..operators import selection as se

#: Defaults of a run. FROZEN ones may not be changed by an overlay.
DEFAULTS = {
    "policy": "whole_field", "q": 0.05, "radii": {"floor": 5.0, "ceiling": 25.0, "step": 0.5, "cap_share": 0.25}, "center_floor": 50.0, "kappa": 2.0, "near_tie": [0.05, 0.01],
    "voxel": 0.5, "step": 0.5, "coverage_limit": 0.5, "removals": 10_000, "master_seed": 20250101,
}
FROZEN = ["policy", "q", "master_seed"]
EXIT = {"COMPLETED": 0, "COMPLETED_WITH_WARNINGS": 0, "COMPLETED_NEGATIVE": 0, "PARTIAL": 0, "FAILED": 1, "BLOCKED": 2, "UNDERPOWERED": 3}


def merged(base: dict, overlay: dict) -> dict:
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in overlay.items()}


def configured(overlay: dict | None = None) -> dict:
    c = merged(DEFAULTS, overlay or {})
    if changed := [k for k in FROZEN if c[k] != DEFAULTS[k]]:
        raise ValueError(f"frozen settings changed: {changed}")
    if unknown := set(c) - set(DEFAULTS):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return c


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def run_id(config: dict, version: str, when: datetime | None = None) -> str:
    return f"{(when or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}_{digest(config)[:8]}_{version[:8]}"


def terminal_state(error: bool = False, underpowered: bool = False, escalated: bool = False, negative: bool = False, incomplete: bool = False, warned: bool = False) -> str:
    """The first that holds: error, underpowered, escalation, negative, incomplete, warnings, completed."""
    for held, state in ((error, "FAILED"), (underpowered, "UNDERPOWERED"), (escalated, "BLOCKED"), (negative, "COMPLETED_NEGATIVE"), (incomplete, "PARTIAL"), (warned, "COMPLETED_WITH_WARNINGS")):
        if held:
            return state
    return "COMPLETED"


@dataclass
class Result:
    state: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return EXIT[self.state]


def analyse(u: DataFrame, cohort: DataFrame, overlay: dict | None = None, radii: list[float] | None = None) -> Result:
    """From a universe and a labelled cohort to regions and footprint, of every gene in them in one go, each at its own radius. The state is
    of all genes together; facts hold a radius for each gene."""
    c = configured(overlay)
    u, cohort = u.cache(), cohort.cache()  # every stage reads them
    n = cohort.groupBy("gene").agg(F.count_if(F.col("class") == "PLP").alias("p"), F.count_if(F.col("class") == "BLB").alias("b")).where("p > 0 and b > 0")
    if n.isEmpty():
        return Result(terminal_state(error=True), facts={"cause": "no cohort with both classes"})
    r = c["radii"]
    radii = radii or [r["floor"] + i * r["step"] for i in range(int((r["ceiling"] - r["floor"]) / r["step"]) + 1)]
    tested = rg.scan(u, cohort, radii, c["q"]).cache()
    power = nu.certificate(tested.withColumn("gene", F.concat_ws("|", "gene", F.col("radius").cast("string"))), c["q"])
    if power.where("passes").isEmpty():
        return Result(terminal_state(underpowered=True), {"tested": tested}, {"cause": "no radius can reject"})
    step = min((b - a for a, b in zip(radii, radii[1:])), default=r["step"])
    rows = rg.objectives(u, cohort, tested, radii, step).cache()
    chosen = se.choose(rows, "radius", rg.OBJECTIVES, ["gene"], ["neighbor_stability", "perm_evidence_zg"], *c["near_tie"]).cache()
    best = chosen.where("rank = 1").select("gene", "radius", "grade").collect()  # a row for each gene
    if not best:
        return Result(terminal_state(incomplete=True), {"scan": rows}, {"cause": "no admissible radius"})
    pick = chosen.where("rank = 1").select("gene", "radius")
    at = {b.gene: b.radius for b in best}
    centers = tested.where("significant").join(pick, ["gene", "radius"]).select("gene", "residue_index", "radius").join(u, ["gene", "residue_index"]).cache()
    tables = {"tested": tested, "scan": rows, "choice": chosen, "centers": centers}
    if centers.isEmpty():
        return Result(terminal_state(negative=True), tables, {"radius": at})
    region = rg.regions(centers)
    ev = fp.evidence(cohort, centers)
    tables |= {"regions": region, "objects": rg.objects(u, cohort, centers, region, pick), "evidence": ev, "containment": fp.containment(ev, pick, c["step"])}
    wide = not rows.join(pick, ["gene", "radius"]).where(F.col("coverage") > c["coverage_limit"]).isEmpty()
    warnings = [f"near tie of radii in {b.gene}: {b.grade}" for b in best if b.grade in ("MAJOR", "ADVISORY")]
    return Result(terminal_state(escalated=wide, warned=bool(warnings)), tables, {"radius": at}, warnings)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compared(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files by path with a verdict: same, changed, missing or unexpected."""
    e, f = expected.select("path", F.col("sha256").alias("want")), found.select("path", F.col("sha256").alias("got"))
    both = e.join(f, "path", "full_outer")
    return both.select("path", F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") == F.col("got"), "same").otherwise("changed").alias("verdict"))


def write_run(result: Result, path: str, config: dict, run: str) -> None:
    """Tables as Parquet, partitioned by gene where they have one, and a JSON handoff with the state and the configuration's digest."""
    for name, df in result.tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("gene") if "gene" in df.columns else w).parquet(f"{path}/{name}")
    spark = next(iter(result.tables.values())).sparkSession if result.tables else SparkSession.getActiveSession()
    handoff = {"run_id": run, "state": result.state, "exit_code": result.exit_code, "facts": result.facts, "warnings": result.warnings, "config_sha256": digest(config), "tables": sorted(result.tables)}
    spark.createDataFrame([(json.dumps(handoff, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/handoff")
