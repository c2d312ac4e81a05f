import gzip
import json

import pytest
from pyspark.sql import functions as F

from lumenfield.plans import runs
from lumenfield.sources import adapter as ad
from lumenfield.sources import payloads, structures, tsv


def test_numbers_as_c_prints_them(spark):
    xs = [0.0, 1.0, 123456.0, 1234567.0, 0.0001234567, 0.00001234, -2.5, 999999.5, 1e-300, 100.0, 3.14159265, 1e20]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(tsv.g6(F.col("x"))).collect()]
    assert got == [f"{x:.6g}" for x in xs]


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", 0.5, True, ["x", "y"]), (2, None, float("nan"), None, [])], "k int, s string, d double, f boolean, l array<string>")
    path = str(tmp_path / "t")
    tsv.write_tsv(df, path, ["k", "s", "d", "f", "l"], order=["k"])
    back = tsv.read_tsv(spark, path, "k int, s string, d double, f boolean, l array<string>").orderBy("k").collect()
    assert [tuple(r) for r in back] == [(1, "a b", 0.5, True, ["x", "y"]), (2, None, None, None, None)]
    assert tsv.read_verbatim(spark, path, "k").columns[0] == "schema_version"
    tsv.write_tsv(df.limit(0), path, ["k", "s", "d", "f", "l"])
    assert tsv.read_tsv(spark, path, "k int").count() == 0
    with pytest.raises(ValueError):
        tsv.write_tsv(df, path, ["k"])
    with pytest.raises(ValueError):
        tsv.read_tsv(spark, path, "k int", forbidden=["s"])


CIF = """data_AF-X-F1
#
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_seq_id
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.type_symbol
ATOM N ALA 1 1 A 0.0 0.0 0.0 1.0 91.0 N
ATOM CA ALA 1 1 A 1.0 2.0 3.0 1.0 91.0 C
ATOM CA ALA 1 1 A 1.5 2.0 3.0 1.0 91.0 C
ATOM "CB" ALA 1 1 A 2.0 2.0 3.0 1.0 91.0 C
ATOM CA GLY . 4 A 4.0 2.0 3.0 0.0 45.0 C
#
"""


def test_mmcif(spark, tmp_path):
    (tmp_path / "m.cif").write_text(CIF)
    res = structures.residues(structures.read_mmcif(spark, str(tmp_path / "m.cif"))).orderBy("residue_index").collect()
    assert [(r.residue_index, r.x_ca, r.ca_usable, r.plddt, r.x_sc) for r in res] == [(1, 1.5, True, 91.0, 2.0), (4, 4.0, False, 45.0, None)]
    df = structures.residues(structures.read_mmcif(spark, str(tmp_path / "m.cif")))
    assert {r.check_name: r.value for r in structures.quality(df).collect()}["n_gaps"] == 1
    c = spark.createDataFrame([(1,), (4,), (9,)], "residue_index int")
    assert [r.unmapped_reason for r in structures.mapped(c, df).orderBy("residue_index").collect()] == [None, "no_ca_coordinate", "residue_not_in_model"]
    assert structures.ca_lines(df).first().value.startswith("ATOM      1  CA  ALA A   1       1.500   2.000   3.000  1.00 91.00")
    assert structures.cif_tokens("a 'b c' \"d e\"  f") == ["a", "b c", "d e", "f"]


def test_payloads(spark):
    entry = {"primaryAccession": "P1", "sequence": {"value": "MK", "length": 2}, "comments": [{"commentType": "SUBUNIT", "texts": [{"value": "Homodimer."}]}], "features": [{"type": "Domain", "description": "D", "location": {"start": {"value": 1}, "end": {"value": 2}}}]}
    e = payloads.entries(spark.createDataFrame([(json.dumps(entry),)], "value string"))
    assert e.first().oligomer == "oligomeric" and [tuple(r) for r in payloads.intervals(e, ["Domain"]).collect()] == [("P1", "Domain", "D", 1, 2)]
    p = [{"entryId": f"AF-{a}-F{f}", "uniprotAccession": a, "latestVersion": 4, "cifUrl": "u"} for a, f in (("P1", 2), ("P1", 1), ("P1-2", 1))]
    r = payloads.predictions(spark.createDataFrame([(json.dumps(p),)], "value string"), "P1").first()
    assert r.entryId == "AF-P1-F1" and r.n_fragments == 2


def test_run(spark, small, tmp_path):
    u = ad.universe(spark, small)
    r = runs.analyse(u, ad.cohort(u), radii=[8.0, 10.0])
    assert r.state in ("COMPLETED", "COMPLETED_WITH_WARNINGS") and r.tables["regions"].count() > 0
    flat = runs.analyse(u, ad.cohort(u, planted=False), radii=[10.0])
    assert flat.state == "COMPLETED_NEGATIVE" and flat.exit_code == 0
    assert runs.analyse(u, ad.cohort(u).where("class = 'PLP'"), radii=[10.0]).state == "FAILED"
    tiny = u.where("residue_index <= 4").withColumn("class", F.when(F.col("residue_index") <= 2, "PLP").otherwise("BLB"))
    assert runs.analyse(u.where("residue_index <= 4"), tiny, radii=[10.0]).exit_code == 3
    r.tables = {"choice": r.tables["choice"]}
    runs.write_run(r, str(tmp_path / "run"), runs.configured(), "id")
    m = runs.manifest(spark, str(tmp_path / "run"))
    assert {x.verdict for x in runs.compared(m, m).collect()} == {"same"}


def test_states_and_configuration():
    assert runs.terminal_state(error=True, negative=True) == "FAILED" and runs.terminal_state(underpowered=True, escalated=True) == "UNDERPOWERED"
    assert runs.terminal_state(escalated=True, negative=True) == "BLOCKED" and runs.terminal_state() == "COMPLETED"
    assert runs.configured({"radii": {"step": 1.0}})["radii"]["floor"] == 5.0
    for bad in ({"q": 0.1}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            runs.configured(bad)


def test_release(spark, tmp_path):
    rows = [("#VariationID", "Name", "GeneSymbol", "Assembly", "Type"), ("1", "a", "ABC;def", "GRCh38", "single nucleotide variant"), ("2", "b", "abc", "GRCh37", "Indel"), ("3", "c", "DEF", "", "Deletion"), ("4", "d", "ABC", "grch38", "copy number gain"), ("5", "e", "XYZ", "GRCh38", "SNV")]
    text = "\n".join("\t".join(r) for r in rows) + "\n"
    (tmp_path / "v.txt").write_text(text)
    (tmp_path / "v.txt.gz").write_bytes(gzip.compress(text.encode()))
    for name in ("v.txt", "v.txt.gz"):
        df = tsv.read_release(spark, str(tmp_path / name), ["abc", "DEF"])
        assert sorted((r.VariationID, r.gene) for r in df.collect()) == [("1", "ABC"), ("1", "DEF"), ("3", "DEF")]
    assert tsv.read_release(spark, str(tmp_path / "v.txt")).count() == 4


def test_transcripts_and_single_entries(spark):
    ref = lambda db, i, **p: {"database": db, "id": i, "properties": [{"key": k, "value": x} for k, x in p.items()]}
    e = {
        "P1": [ref("RefSeq", "NP_1", NucleotideSequenceId="NM_9.1"), ref("MANE-Select", "ENST1.2", RefSeqNucleotideId="NM_1.4")],
        "P2": [ref("RefSeq", "NP_1", NucleotideSequenceId="NM_2.1"), ref("RefSeq", "NP_2", NucleotideSequenceId="NM_3.1")],
        "P3": [ref("RefSeq", "NP_5"), ref("RefSeq", "NP_4")], "P4": [],
    }
    df = spark.createDataFrame([(json.dumps({"primaryAccession": k, "uniProtKBCrossReferences": v}),) for k, v in e.items()], "value string")
    got = {r.accession: (r.transcript, r.refseq, r.source) for r in payloads.transcripts(df).collect()}
    assert got == {"P1": ("ENST1.2", "NM_1.4", "selected_pair"), "P2": ("NM_3.1", "NM_3.1", "last_nucleotide"), "P3": ("NP_5", None, "last_protein"), "P4": (None, None, "none")}
    found = spark.createDataFrame([("A", json.dumps({"results": [{"primaryAccession": "P1"}]})), ("B", json.dumps({"results": []})), ("C", json.dumps({"results": [{"primaryAccession": "P1"}, {"primaryAccession": "P2"}]}))], "gene string, value string")
    assert {r.gene: (r.n_results, r.accession) for r in payloads.single_entry(found, "gene").collect()} == {"A": (1, "P1"), "B": (0, None), "C": (2, None)}
    text = spark.createDataFrame([("Forms a homo-dimer.",), ("Monomer.",), ("Heterotetramers of two kinds",), ("Binds X",), ("",), (None,), ("Homodimerization is mediated by X.",), ("HOMODIMERS; binds X",), ("Hetero-oligomer",), ("A non-homodimer.",), ("homo dimer",), ("prehomodimer",)], "t string").withColumn("oligomer", payloads.oligomer(F.col("t")))
    assert [r.oligomer for r in text.collect()] == ["oligomeric", "monomer", "oligomeric", "monomer", "unknown", "unknown", "monomer", "oligomeric", "oligomeric", "oligomeric", "monomer", "monomer"]
    assert [r.permitted for r in payloads.assembly_permitted(text.limit(6), False).collect()] == [False, True, False, True, True, True]


def test_numbering_and_checks(spark, tmp_path):
    seq = lambda e, t: [(e, i + 1, c) for i, c in enumerate(t)]
    m = spark.createDataFrame(seq("a", "MKVLA") + seq("b", "VLAG") + seq("c", "WWW"), "entry string, position int, aa string")
    c = spark.createDataFrame(seq("a", "MKVLA") + seq("b", "MKVLAG") + seq("c", "MKV"), "entry string, position int, aa string")
    got = {r.entry: (r.offset, r.longest, r.n_overlap, r.n_matched, r.identity) for r in structures.numbering(m, c).collect()}
    assert got == {"a": (0, 5, 5, 5, 1.0), "b": (2, 4, 4, 4, 1.0), "c": (0, 0, 3, 0, 0.0)}
    (tmp_path / "m.cif").write_text(CIF)
    res = structures.residues(structures.read_mmcif(spark, str(tmp_path / "m.cif")))
    entry = res.first().entry
    canonical = spark.createDataFrame([(entry, 1, "A"), (entry, 2, "G")], "entry string, position int, aa string")
    one = spark.createDataFrame([(entry, 1)], "entry string, n_fragments int")
    bad = {r.check for r in structures.checks(res, canonical, one).collect() if not r.passed}
    assert bad == {"contiguous", "ca_usable"} | ({"identity"} if structures.numbering(res.selectExpr("entry", "residue_index as position", "case when aa3 = 'ALA' then 'A' else 'G' end as aa"), canonical).first().identity < 1 else set())
    assert structures.unusable(res).first().reason == "ca_not_usable"
    structures.write_cif(res, str(tmp_path / "out"))
    back = structures.residues(structures.read_mmcif(spark, str(tmp_path / "out"))).collect()
    assert [(r.residue_index, r.x_ca, r.plddt) for r in back] == [(1, 1.5, 91.0)]


def test_queries_do_not_window_over_everything(spark, small):
    """No window of a query lacks a partition: such a plan would sort the table in one task."""
    from lumenfield import queries as q

    for name in ("significant_centers", "radius_choice", "star_cube", "containment_radius"):
        plan = q.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan and "windowspecdefinition(residue_index" not in plan, name


def test_entries_without_the_training_operators(monkeypatch):
    """The analytics queries stay when lumenfield.llm is gone, with or without corpus_pipeline.py."""
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("lumenfield.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name="lumenfield.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    from lumenfield import queries as q

    assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.ORACLES)
