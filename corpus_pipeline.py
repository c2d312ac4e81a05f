"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

quality: documents that the classifier rejects go. near_duplicates: one document of each group stays. benchmark: a
document that holds any ten-word window of a benchmark item goes. personal_data: spans are masked in the text.
pieces: the texts' SentencePiece ids are added, checked by decoding. All stages but the last return the columns of
documents; rows are otherwise kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm.common import crc_text, free_name, stored, table
from lumenfield.llm.decontaminate import without_windows
from lumenfield.llm.ngram_join import one_of_each
from lumenfield.llm.pieces import encode_checked
from lumenfield.llm.pii import find_spans, masked
from lumenfield.llm.quality import score, train
from lumenfield.llm.queries import PIECES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of at least 0.5; the model has learned from the labels that op4 learns from too."""
    labels = table(spark, sf_dir, "labels").where(crc_text("doc_id") % 3 != 1)
    out = free_name(docs, "score")
    return score(docs, train(docs, labels), out=out).where(F.col(out) >= 0.5).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one with the smallest doc_id."""
    return one_of_each(docs).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark window."""
    return without_windows(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked and n_chars counted anew."""
    out = free_name(docs, "spans")
    changed = F.size(out) > 0
    found = find_spans(docs, out=out).withColumn("text", masked(F.col("text"), F.col(out)))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their ids, how many they are, and whether they decode to the text (in place of columns of these names)."""
    coded = encode_checked(docs, PIECES)
    kept = [c for c in docs.columns if c not in ("ids", "n_pieces", "round_trip")]
    return coded.select(*kept, "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("pieces", pieces),
]

#: Neither the trained classifier nor the tokenizer can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of sf_dir; what they hand on lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
