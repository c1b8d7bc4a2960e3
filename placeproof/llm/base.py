"""Shared pieces: table reads, materialised stages, word patterns and the hold-out rule."""
import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.session import work_path

#: A word: a run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Characters of a text handled at once.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stage(df: DataFrame, name: str, release: bool = False, **options) -> DataFrame:
    """Write once below the shared folder and read back: later jobs start there, also after a lost executor.

    release: let the driver collect its garbage at once, whereupon Spark drops the shuffle files of the jobs that are over; worth it
    behind a large shuffle, whose files would else stay beside those of the next.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(**options).parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def word_count(text) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def blocks_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def give_back() -> None:
    """Return freed memory to the system: a Python worker that waits for its next task should not keep what the last one needed."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def pieces(batch: pa.RecordBatch, text: str, chars: int = 1 << 21, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few rows and not much text (a longer single text is a slice of its own)."""
    column = batch.column(batch.schema.get_field_index(text))
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    at = 0
    while at < batch.num_rows:
        end, total = at, 0
        while end < batch.num_rows and end - at < rows and (end == at or total + size[end] <= chars):
            total += int(size[end])
            end += 1
        yield batch.slice(at, end - at)
        at = end
