"""What the operators of this package share: inputs, the shared folder, and packed blocks."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that with_arrow() hands over at once.
SLICE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or where none is set a temporary one of our own, which
    only a local master can share with itself; a cluster without one is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later readers don't repeat its work, and a lost
    executor loses none of it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size in bytes (for files: their length); no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions that hold about bytes_each of the input each; never fewer than the session's shuffle partitions."""
    size = input_bytes(df)
    wanted = math.ceil(size / bytes_each) if size < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def crc_text(col: Column | str) -> Column:
    """Unsigned CRC-32 of a column cast to text, in UTF-8."""
    return F.crc32(F.encode(F.col(col).cast("string") if isinstance(col, str) else col, "UTF-8"))


def text_runs(texts: list[str | None], most: int = 1_000_000, rows: int = 500) -> Iterator[list[str | None]]:
    """The texts in runs of at most ``rows``, each ending with the text that brings it to ``most`` characters: a run's
    size follows from the longest text, not from how many there are."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= most or len(held) >= rows:
            yield held
            held, size = [], 0
    if held:
        yield held


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Oracle SQL (DuckDB): a macro-free CRC-32 of text column {t}; crc_table makes its 256 entries by rule.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(v ORDER BY i) AS crc_t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(t: str) -> str:
    """Needs crc_table in the FROM clause."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, crc_t[1 + (xor(a, b) & 255)])), 4294967295)"""


def trim() -> None:
    """Gives this worker's freed memory back to the system, where the C library can: the workers of an executor share
    its memory, and one that has done a large piece would otherwise keep the most it ever used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def with_arrow(df: DataFrame, inputs: list[str], out: str, kind: str, start: Callable[[], Callable[..., pa.Array]]) -> DataFrame:
    """df with a column ``out`` (replaced if there) of type ``kind``; start() runs once a task and gives the function
    that makes a batch's column from the columns ``inputs``."""
    schema = df.withColumn(out, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            at = dict(zip(b.schema.names, b.columns))
            at[out] = make(*(at[n] for n in inputs))
            yield pa.RecordBatch.from_arrays([at[f.name] for f in schema], names=schema.names)
        del make
        trim()  # a worker that waits for its next task keeps nothing of this one

    return df.mapInArrow(run, schema)
