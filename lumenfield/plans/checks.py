"""Expectations that are checked while a table is written, and handoffs that are refused when they don't hold together."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .runs import EXIT, digest

VERDICTS = "table string, rule string, broken long, rows long, holds boolean"
REQUIRED = ["run_id", "state", "exit_code", "facts", "warnings", "config_sha256", "tables"]


class Broken(ValueError):
    """What doesn't hold; its parts are in ``problems``."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def write_checked(df: DataFrame, path: str, name: str, rules: dict[str, Column], rows: int | None = None) -> DataFrame:
    """Writes df to path/name and its verdicts to path/_verdicts/name, and returns these: for each rule how many rows break it (a rule that is null
    is broken), and for "rows" how many there are against ``rows`` expected. The counts are made by the write itself; nothing is read again.

    Raises Broken, after both are written, if a rule doesn't hold: read_checked() refuses such a table.
    """
    seen = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows"), *(F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"rule_{i}") for i, rule in enumerate(rules.values()))]
    df.observe(seen, *metrics).write.mode("overwrite").parquet(f"{path}/{name}")
    found = seen.get
    n = int(found["rows"])
    verdicts = [(name, rule, int(found[f"rule_{i}"]), n, found[f"rule_{i}"] == 0) for i, rule in enumerate(rules)]
    verdicts.append((name, "rows", 0 if rows is None else abs(n - rows), n, rows is None or n == rows))
    out = df.sparkSession.createDataFrame(verdicts, VERDICTS)
    out.coalesce(1).write.mode("overwrite").parquet(f"{path}/_verdicts/{name}")
    if bad := [f"{name}: {rule} is broken by {broken} of {n} rows" for _, rule, broken, _, holds in verdicts if not holds]:
        raise Broken(bad)
    return out


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_checked(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table, if it was written by write_checked() and all of its rules held."""
    if not _there(spark, f"{path}/_verdicts/{name}"):
        raise Broken([f"{name}: was not checked"])
    if bad := [f"{name}: {r.rule} is broken by {r.broken} of {r.rows} rows" for r in spark.read.schema(VERDICTS).parquet(f"{path}/_verdicts/{name}").collect() if not r.holds]:
        raise Broken(bad)
    return spark.read.parquet(f"{path}/{name}")


def load_handoff(spark: SparkSession, path: str, config: dict | None = None) -> dict:
    """The handoff that write_run() left under path. Raises Broken with all that is wrong: text that is no JSON object, keys that are missing, a state
    that is none or doesn't have this exit code, a configuration other than config's, tables that are listed and not there, or checked and broken."""
    text = "\n".join(r.value for r in spark.read.text(f"{path}/handoff").collect())
    try:
        h = json.loads(text)
    except json.JSONDecodeError as e:
        raise Broken([f"no JSON: {e}"]) from e
    if not isinstance(h, dict):
        raise Broken(["no JSON object"])
    if missing := [k for k in REQUIRED if k not in h]:
        raise Broken([f"missing: {k}" for k in missing])
    bad = []
    if h["state"] not in EXIT:
        bad.append(f"unknown state: {h['state']}")
    elif h["exit_code"] != EXIT[h["state"]]:
        bad.append(f"{h['state']} does not end with {h['exit_code']}")
    if config is not None and h["config_sha256"] != digest(config):
        bad.append("made with another configuration")
    for name in h["tables"]:
        if not _there(spark, f"{path}/{name}"):
            bad.append(f"{name}: is not there")
        elif _there(spark, f"{path}/_verdicts/{name}"):
            try:
                read_checked(spark, path, name)
            except Broken as e:
                bad += e.problems
    if bad:
        raise Broken(bad)
    return h
