"""JSON payloads of protein resources as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = """primaryAccession string, sequence struct<value: string, length: int>,
comments array<struct<commentType: string, texts: array<struct<value: string>>>>,
features array<struct<type: string, description: string, location: struct<start: struct<value: int>, `end`: struct<value: int>>>>"""
PREDICTIONS = "array<struct<entryId: string, uniprotAccession: string, latestVersion: int, cifUrl: string>>"


def entries(df: DataFrame, payload: str = "value") -> DataFrame:
    """accession, sequence, subunit (all subunit texts), oligomer and features of entry payloads."""
    e = df.select(F.from_json(F.col(payload), ENTRY).alias("e"))
    texts = F.flatten(F.transform(F.filter("e.comments", lambda c: c["commentType"] == "SUBUNIT"), lambda c: c["texts"]["value"]))
    subunit = F.concat_ws(" ", texts)
    return e.select(F.col("e.primaryAccession").alias("accession"), F.col("e.sequence.value").alias("sequence"), subunit.alias("subunit"), oligomer(subunit).alias("oligomer"), F.col("e.features").alias("features"))


#: The words by which subunit texts count chains, and the kinds of assembly that they are said of.
CHAIN_COUNTS = ["dimer", "trimer", "tetramer", "pentamer", "hexamer", "heptamer", "octamer", "nonamer", "decamer", "dodecamer", "oligomer", "multimer"]
KINDS = ["homo", "hetero"]


def oligomer(text: Column) -> Column:
    """oligomeric where a word of a subunit text is an assembly (a kind and a count, in one word or with a hyphen, also in the plural), monomer
    where the text says anything else, unknown where there is none. A longer word that begins so, as homodimerization, is none."""
    words = F.split(F.regexp_replace(F.lower(text), f"(?<![\\p{{L}}\\p{{N}}_])({'|'.join(KINDS)})-", "$1"), "[^\\p{L}\\p{N}_]+")
    assemblies = F.array(*(F.lit(kind + count + plural) for kind in KINDS for count in CHAIN_COUNTS for plural in ("", "s")))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "unknown").when(F.arrays_overlap(words, assemblies), "oligomeric").otherwise("monomer")


def assembly_permitted(entry: DataFrame, allow_monomer: bool) -> DataFrame:
    """entry with permitted and intra_subunit_only: an oligomer on a model of one chain needs leave."""
    bound = F.col("oligomer") == "oligomeric"
    return entry.withColumn("permitted", ~bound | F.lit(allow_monomer)).withColumn("intra_subunit_only", bound & F.lit(allow_monomer))


def single_entry(df: DataFrame, by: str, payload: str = "value") -> DataFrame:
    """(by, n_results, accession) of search payloads: the accession only where there is exactly one result; others have to be decided by
    someone."""
    found = F.from_json(F.col(payload), "results array<struct<primaryAccession: string>>")["results"]
    n = F.coalesce(F.size(F.when(found.isNotNull(), found)), F.lit(0))
    return df.select(by, F.greatest(n, F.lit(0)).alias("n_results"), F.when(n == 1, found[0]["primaryAccession"]).alias("accession"))


REFERENCES = "uniProtKBCrossReferences array<struct<database: string, id: string, properties: array<struct<key: string, value: string>>>>"


def transcripts(df: DataFrame, payload: str = "value") -> DataFrame:
    """(accession, transcript, refseq, source) of entries: the selected pair where it is named, else the last of the sorted nucleotide
    accessions, or of the protein accessions if no reference has one; an entry without any has nulls and the source none."""
    e = df.select(F.from_json(F.col(payload), f"primaryAccession string, {REFERENCES}").alias("e")).select(F.col("e.primaryAccession").alias("accession"), F.coalesce("e.uniProtKBCrossReferences", F.array().cast(REFERENCES.split(" ", 1)[1])).alias("refs"))
    of = lambda *names: F.filter("refs", lambda r: F.upper(r["database"]).isin(list(names)))
    prop = lambda r, key: F.get(F.filter(r["properties"], lambda p: p["key"] == key), F.lit(0))["value"]
    e = e.select("accession", F.get(of("MANE-SELECT", "MANE_SELECT"), F.lit(0)).alias("mane"), of("REFSEQ").alias("refseq"))
    nt = F.array_sort(F.filter(F.transform("refseq", lambda r: prop(r, "NucleotideSequenceId")), lambda x: x.isNotNull()))
    protein = F.array_sort(F.transform("refseq", lambda r: r["id"]))
    has, some = F.col("mane").isNotNull(), F.size("refseq") > 0
    last = lambda a: F.get(a, F.size(a) - 1)
    source = F.when(has, "selected_pair").when(some & (F.size(nt) > 0), "last_nucleotide").when(some, "last_protein").otherwise("none")
    return e.select("accession", F.when(has, F.col("mane.id")).when(F.size(nt) > 0, last(nt)).when(some, last(protein)).alias("transcript"), F.when(has, prop(F.col("mane"), "RefSeqNucleotideId")).when(F.size(nt) > 0, last(nt)).alias("refseq"), source.alias("source"))


def intervals(entry: DataFrame, kinds: list[str]) -> DataFrame:
    """(accession, kind, name, start, stop) of an entry's features of the given kinds."""
    f = entry.select("accession", F.explode("features").alias("f")).where(F.col("f.type").isin(kinds))
    return f.select("accession", F.col("f.type").alias("kind"), F.col("f.description").alias("name"), F.col("f.location.start.value").alias("start"), F.col("f.location.end.value").alias("stop"))


def predictions(df: DataFrame, accession: str, payload: str = "value") -> DataFrame:
    """The model of an accession (its isoforms are other molecules): lowest fragment, and how many fragments there are."""
    p = df.select(F.explode(F.from_json(F.col(payload), PREDICTIONS)).alias("p")).select("p.*")
    own = F.regexp_extract("entryId", r"^AF-(.+)-F\d+$", 1)
    fragment = F.regexp_extract("entryId", r"-F(\d+)$", 1).try_cast("int")
    r = p.withColumn("accession", own).withColumn("fragment", fragment).where(F.col("accession") == accession)
    return r.groupBy("accession").agg(F.min_by(F.struct("entryId", "latestVersion", "cifUrl"), "fragment").alias("m"), F.count(F.lit(1)).alias("n_fragments")).select("accession", "m.*", "n_fragments")


def dssp(lines: DataFrame) -> DataFrame:
    """(residue_index, code) of fixed-width secondary structure lines: columns 6 to 10 and 17."""
    return lines.select(F.trim(F.substring("value", 6, 5)).try_cast("int").alias("residue_index"), F.substring("value", 17, 1).alias("code")).where("residue_index is not null")


def structure_class(code: Column) -> Column:
    return F.when(code.isin("H", "G", "I"), "helix").when(code.isin("E", "B"), "strand").otherwise("coil")
