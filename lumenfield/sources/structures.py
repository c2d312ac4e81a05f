"""Coordinate models: mmCIF to an atom table, residues, quality checks, mapping of a cohort, and CA-only output."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.variants import AA3

ATOMS = "entry string, chain string, residue_index int, aa3 string, atom string, x double, y double, z double, occupancy double, b_factor double, element string, line int"
_TOKEN = re.compile(r"""'([^']*)'|"([^"]*)"|([^\s'"]+)""")


def cif_tokens(line: str) -> list[str]:
    """The values of a row: quoted ones whole, others split at white space."""
    return [next(g for g in m.groups() if g is not None) for m in _TOKEN.finditer(line)]


def cif_loops(text: str) -> Iterator[tuple[list[str], list[list[str]]]]:
    """(names, rows) of each loop of a file."""
    names: list[str] = []
    rows: list[list[str]] = []
    state = ""
    for line in (*text.splitlines(), "#"):
        s = line.strip()
        if s == "loop_":
            if names:
                yield names, rows
            names, rows, state = [], [], "names"
        elif state == "names" and s.startswith("_"):
            names.append(s.split()[0])
        elif state and (not s or s[0] in "#_" or s.startswith("data_")):
            if names:
                yield names, rows
            names, rows, state = [], [], ""
        elif state:
            state = "rows"
            rows.append(cif_tokens(s))
    if names:
        yield names, rows


def _number(text: str | None) -> float | None:
    try:
        return float(text or "")
    except ValueError:
        return None


def parse_cif(text: str) -> list[tuple]:
    """Rows of ATOMS. A residue's number is label_seq_id, else auth_seq_id; atoms without either are left out."""
    entry = next((line.strip()[5:].strip() for line in text.splitlines() if line.strip().startswith("data_")), "") or "NA"
    out = []
    for names, rows in cif_loops(text):
        if not names[0].startswith("_atom_site."):
            continue
        short = [n.removeprefix("_atom_site.") for n in names]
        for k, row in enumerate(rows):
            r = dict(zip(short, row))
            number = next((int(r[c]) for c in ("label_seq_id", "auth_seq_id") if re.fullmatch(r"-?\d+", r.get(c, ""))), None)
            if number is None or r.get("group_PDB", "ATOM") not in ("ATOM", "HETATM"):
                continue
            pick = lambda *cs: next((r[c] for c in cs if r.get(c)), None)  # noqa: E731, B023
            occupancy = _number(r.get("occupancy"))
            out.append((entry, pick("auth_asym_id", "label_asym_id") or "A", number, pick("label_comp_id", "auth_comp_id") or "UNK", pick("label_atom_id", "auth_atom_id") or "", _number(r.get("Cartn_x")), _number(r.get("Cartn_y")), _number(r.get("Cartn_z")), 1.0 if occupancy is None else occupancy, _number(r.get("B_iso_or_equiv")) or 0.0, pick("type_symbol") or "C", k))
    return out


def read_mmcif(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of all files under path, one task a file."""
    names = [f.split()[0] for f in ATOMS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                yield pd.DataFrame(parse_cif(text), columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(run, ATOMS)


def residues(atoms: DataFrame) -> DataFrame:
    """A row per residue: CA, CB and side-chain centroid, confidence, and whether its CA is usable (there, finite, occupancy over 0).
    Of atoms of one name the last counts."""
    last = F.row_number().over(Window.partitionBy("entry", "chain", "residue_index", "atom").orderBy(F.desc("line")))
    a = atoms.withColumn("_n", last).where("_n = 1")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = finite("x") & finite("y") & finite("z")
    of = lambda name, c: F.max(F.when(F.col("atom") == name, F.col(c))).alias(f"{c}_{name.lower()}")
    side = good & ~F.col("atom").isin("N", "CA", "C", "O", "OXT") & (F.col("element") != "H")
    g = a.groupBy("entry", "chain", "residue_index").agg(F.first("aa3").alias("aa3"), *(of(n, c) for n in ("CA", "CB") for c in "xyz"), *(F.avg(F.when(side, F.col(c))).alias(f"{c}_sc") for c in "xyz"), of("CA", "b_factor"), F.max(F.when((F.col("atom") == "CA") & good & (F.col("occupancy") > 0), True)).alias("_ok"))
    return g.withColumn("ca_usable", F.coalesce("_ok", F.lit(False))).withColumnRenamed("b_factor_ca", "plddt").drop("_ok")


def quality(res: DataFrame) -> DataFrame:
    """(entry, check_name, value): chains, residues, usable CA, numbering gaps, repeats and confidence range."""
    gap = F.col("residue_index") - F.lag("residue_index").over(Window.partitionBy("entry", "chain").orderBy("residue_index"))
    r = res.withColumn("_gap", gap)
    row = r.groupBy("entry").agg(F.count_distinct("chain").alias("n_chains"), F.count(F.lit(1)).alias("n_residues"), F.count_if("ca_usable").alias("n_usable"), F.count_if(F.col("_gap") > 1).alias("n_gaps"), F.min("plddt").alias("plddt_min"), F.max("plddt").alias("plddt_max"))
    names = ["n_chains", "n_residues", "n_usable", "n_gaps", "plddt_min", "plddt_max"]
    return row.select("entry", F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).cast("double").alias("value")) for n in names))).alias("c")).select("entry", "c.*")


def numbering(model: DataFrame, canonical: DataFrame) -> DataFrame:
    """(entry, offset, longest, n_overlap, n_matched, identity): how a model's numbering lies on the canonical sequence. Both are (entry,
    position, aa). The longest run of equal letters on one diagonal gives the offset (ties: the first in the model, then in the
    sequence); the rest is counted along it. Nothing is renumbered."""
    m, c = model.select("entry", F.col("position").alias("i"), "aa"), canonical.select("entry", F.col("position").alias("j"), "aa")
    hit = m.join(c, ["entry", "aa"]).withColumn("shift", F.col("j") - F.col("i"))
    run = hit.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("entry", "shift").orderBy("i"))).groupBy("entry", "shift", "island").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    best = run.groupBy("entry").agg(F.max(F.struct("n", (-F.col("first")).alias("a"), (-(F.col("first") + F.col("shift"))).alias("b"), "shift")).alias("m"))
    best = model.select("entry").distinct().join(best, "entry", "left").select("entry", F.coalesce("m.shift", F.lit(0)).alias("offset"), F.coalesce("m.n", F.lit(0)).alias("longest"))
    both = m.join(best, "entry").join(c.withColumnRenamed("aa", "aa2"), "entry").where(F.col("j") == F.col("i") + F.col("offset"))
    n = both.groupBy("entry").agg(F.count(F.lit(1)).alias("n_overlap"), F.count_if(F.col("aa") == F.col("aa2")).alias("n_matched"))
    out = best.join(n, "entry", "left").fillna(0, ["n_overlap", "n_matched"])
    return out.withColumn("identity", F.when((F.col("longest") > 0) & (F.col("n_overlap") > 0), F.col("n_matched") / F.col("n_overlap")).otherwise(0.0))


def checks(res: DataFrame, canonical: DataFrame, fragments: DataFrame, chains: tuple[str, ...] = ("A",)) -> DataFrame:
    """(entry, check, passed, severity): twelve checks of a model, none of which repairs anything. canonical: (entry, position, aa);
    fragments: (entry, n_fragments)."""
    one = F.element_at(F.create_map(*(F.lit(x) for kv in AA3.items() for x in kv)), F.upper("aa3"))
    r = res.withColumn("aa", F.coalesce(one, F.lit("X")))
    gap = F.col("residue_index") - F.lag("residue_index").over(Window.partitionBy("entry", "chain").orderBy("residue_index"))
    g = r.withColumn("gap", gap).withColumn("again", F.count(F.lit(1)).over(Window.partitionBy("entry", "residue_index"))).groupBy("entry").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("chain")).alias("own_chains"), F.count_if(F.col("again") > 1).alias("n_again"), F.count_if(F.col("gap") > 1).alias("n_gaps"), F.count_if(F.col("aa") == "X").alias("n_odd"),
        F.count_if(F.col("x_ca").isNull()).alias("n_no_ca"), F.count_if(F.col("x_ca").isNotNull() & ~F.col("ca_usable")).alias("n_bad_ca"), F.count_if(F.col("plddt").isNull()).alias("n_no_plddt"))
    every = canonical.select("entry").union(fragments.select("entry")).union(res.select("entry")).distinct()
    size = canonical.groupBy("entry").agg(F.count(F.lit(1)).alias("length"))
    a = numbering(r.select("entry", F.col("residue_index").alias("position"), "aa"), canonical)
    t = every.join(g, "entry", "left").join(size, "entry", "left").join(a, "entry", "left").join(fragments, "entry", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    rules = [
        ("has_residues", F.col("n") > 0, "BLOCKING"), ("chains", F.col("own_chains") == F.array(*(F.lit(c) for c in sorted(chains))), "BLOCKING"), ("unique_numbers", none("n_again"), "BLOCKING"), ("contiguous", none("n_gaps"), "MAJOR"),
        ("full_length", F.col("n") == F.col("length"), "BLOCKING"), ("standard_residues", none("n_odd"), "MAJOR"), ("all_have_ca", none("n_no_ca"), "MAJOR"), ("ca_usable", none("n_bad_ca"), "MAJOR"),
        ("confidence_present", none("n_no_plddt"), "BLOCKING"), ("identity", F.col("identity") >= 1.0, "BLOCKING"), ("no_offset", F.col("offset") == 0, "BLOCKING"), ("one_fragment", F.col("n_fragments") == 1, "BLOCKING"),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), F.lit(s).alias("severity")) for k, ok, s in rules))).alias("c")
    return t.select("entry", each).select("entry", "c.*")


def unusable(res: DataFrame) -> DataFrame:
    """(entry, chain, residue_index, reason) of the residues that can't be in the universe."""
    why = F.when(F.col("x_ca").isNull(), "no_ca_coordinate").otherwise("ca_not_usable")
    return res.where("not ca_usable").select("entry", "chain", "residue_index", why.alias("reason"))


def cif_lines(res: DataFrame, value: Column | None = None) -> DataFrame:
    """(residue_index, value): the lines of an mmCIF atom table of CA atoms, after its header CIF_HEADER; the last number is the residue's
    value (by default its confidence)."""
    b = value if value is not None else F.coalesce("plddt", F.lit(0.0))
    r = res.where("ca_usable")
    return r.select("residue_index", F.format_string("ATOM %d C CA . %s %s 1 %d ? %.3f %.3f %.3f 1.00 %.2f %d %s %s CA 1", "residue_index", "aa3", "chain", "residue_index", "x_ca", "y_ca", "z_ca", b, "residue_index", "aa3", "chain").alias("value"))


CIF_HEADER = ["data_model", "loop_"] + [f"_atom_site.{c}" for c in "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_entity_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv auth_seq_id auth_comp_id auth_asym_id auth_atom_id pdbx_PDB_model_num".split()]


def write_cif(res: DataFrame, path: str, value: Column | None = None) -> None:
    """One file of the residues of one model (some thousand lines): header, atoms by number, end mark."""
    head = res.sparkSession.createDataFrame([(-len(CIF_HEADER) + i, line) for i, line in enumerate(CIF_HEADER)] + [(1 << 30, "#")], "residue_index int, value string")
    head.union(cif_lines(res, value).select(F.col("residue_index").cast("int"), "value")).coalesce(1).sortWithinPartitions("residue_index").select("value").write.mode("overwrite").text(path)


def mapped(cohort: DataFrame, res: DataFrame) -> DataFrame:
    """cohort rows with their CA, and for those without one the reason; they meet by entry and chain too, where cohort has them."""
    by = [k for k in ("entry", "chain") if k in cohort.columns] + ["residue_index"]
    c = res.select(*by, "x_ca", "y_ca", "z_ca", "plddt", "ca_usable")
    out = cohort.join(c, by, "left")
    return out.withColumn("unmapped_reason", F.when(F.col("ca_usable").isNull(), "residue_not_in_model").when(~F.col("ca_usable"), "no_ca_coordinate"))


def ca_lines(res: DataFrame, value: Column | None = None) -> DataFrame:
    """(residue_index, value): CA-only PDB lines; residues over 9999 have no place in the format and are left out."""
    r = res.where("ca_usable and residue_index between 1 and 9999")
    b = value if value is not None else F.coalesce("plddt", F.lit(0.0))
    return r.select("residue_index", F.format_string("ATOM  %5d  CA  %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f           C  ", "residue_index", "aa3", "chain", "residue_index", "x_ca", "y_ca", "z_ca", F.lit(1.0), b).alias("value"))


def write_pdb(res: DataFrame, path: str) -> None:
    ca_lines(res).orderBy("residue_index").select("value").coalesce(1).write.mode("overwrite").text(path)
