"""Canonical TSV: frozen columns, NA for what is missing, TRUE and FALSE, six significant digits, lists joined by semicolons.

Parquet is the primary sink; TSV is for exchange. Files are written by Spark, so any store it reaches will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NA = "NA"


def g6(c: Column, digits: int = 6) -> Column:
    """Like C's %g: trailing zeros dropped, an exponent of two digits below 1e-4 and from 1e6 on. Java's %g does neither."""
    e = F.floor(F.log10(F.abs(c)))
    # the exponent after rounding to the digits, which may carry into the next
    mantissa = F.format_string(f"%.{digits - 1}e", c)
    e = F.when(c == 0, F.lit(0)).otherwise(F.split_part(mantissa, F.lit("e"), F.lit(2)).try_cast("int"))
    strip = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.lit(None).cast("string")
    for k in range(-4, digits):
        plain = F.coalesce(plain, F.when(e == k, strip(F.format_string(f"%.{digits - 1 - k}f", c))))
    scientific = F.concat(strip(F.split_part(mantissa, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(mantissa, F.lit("e"), F.lit(2)))
    return F.when(c == 0, "0").when((e >= -4) & (e < digits), plain).otherwise(scientific)


def cell(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(c, lambda x: cell(x, kind.elementType)), ";")
        return F.when(c.isNull() | (F.size(c) == 0), NA).otherwise(inner)
    if isinstance(kind, T.BooleanType):
        return F.when(c.isNull(), NA).when(c, "TRUE").otherwise("FALSE")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), NA).otherwise(g6(d))
    text = F.regexp_replace(c.cast("string"), r"[\t\n\r]", " ")
    return F.when(text.isNull() | (text == ""), NA).otherwise(text)


def write_tsv(df: DataFrame, path: str, columns: list[str], version: str = "1.0", order: list[str] | None = None) -> None:
    """df under a frozen column order, in one file; the header is there even without rows, and a column that isn't declared raises."""
    unknown = set(df.columns) - set(columns) - {"schema_version"}
    if unknown:
        raise ValueError(f"columns {sorted(unknown)} are not in the frozen schema {columns}")
    cols = columns if "schema_version" in columns else ["schema_version", *columns]
    known = dict((f.name, f.dataType) for f in df.schema)
    value = lambda n: cell(F.col(n), known[n]) if n in known else F.lit(version if n == "schema_version" else NA)
    rows = df.orderBy(*order) if order else df
    lines = rows.select(F.concat_ws("\t", *(value(n) for n in cols)).alias("value"), F.monotonically_increasing_id().alias("_at"))
    head = df.sparkSession.createDataFrame([("\t".join(cols), -1)], "value string, _at long")
    head.union(lines).coalesce(1).sortWithinPartitions("_at").select("value").write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, forbidden: list[str] | None = None) -> DataFrame:
    """A canonical TSV under a declared schema. A forbidden column in the header, or a declared one that is missing, raises."""
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if leaked := set(raw.columns) & set(forbidden or []):
        raise ValueError(f"forbidden columns {sorted(leaked)}")
    if missing := [f.name for f in schema if f.name not in raw.columns]:
        raise ValueError(f"missing columns {missing}")

    def parsed(f: T.StructField) -> Column:
        c = F.when(F.col(f.name) != NA, F.col(f.name))
        if isinstance(f.dataType, T.ArrayType):
            return F.split(c, ";").cast(f.dataType).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return raw.select(*(parsed(f) for f in schema))


def read_verbatim(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All cells as text; a key that repeats raises."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats in {path}")
    return df


#: Record types of the release that are substitutions or small changes.
RELEASE_TYPES = ["single nucleotide variant", "snv", "variation", "indel", "missense variant", "deletion", "duplication", "insertion"]


def read_release(spark: SparkSession, path: str, genes: list[str] | None = None, assembly: str = "GRCh38") -> DataFrame:
    """Records of a release (tab-separated text, plain or gzipped, with a header that may begin with #), all cells as text, each with
    the gene (upper case) that it is of.

    A record of several genes (symbols joined by semicolons) has a row for each one wanted; another assembly than the wanted
    one goes, a blank one stays; only RELEASE_TYPES stay. Neither significance nor review decide anything here.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    first = raw.columns[0]
    df = raw.withColumnRenamed(first, first.lstrip("#").strip())
    clean = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    same = clean("Assembly").isin("", assembly.strip().upper()) if "Assembly" in df.columns else F.lit(True)
    kind = F.lower(F.trim(F.coalesce(F.col("Type"), F.lit("")))).isin(RELEASE_TYPES)
    each = df.where(same & kind).withColumn("gene", F.explode(F.array_distinct(F.transform(F.split(clean("GeneSymbol"), ";"), lambda x: F.trim(x)))))
    return each.where(F.col("gene").isin([g.strip().upper() for g in genes])) if genes else each.where("gene <> ''")
