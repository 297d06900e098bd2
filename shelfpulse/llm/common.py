"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfpulse.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of repeating the
    stages before.  Column names must be unique.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(mod: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (NULL ids count as the text '')."""
    c = F.col(mod) if isinstance(mod, str) else mod
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % divisor


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; NULL reads as the empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def text_key(col: str = "text") -> Column:
    """64-bit hash of a text column; NULL reads as the empty text."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def slices(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts are Python objects at a time."""
    for batch in it:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``mapInArrow`` with a per-batch function; ``None`` means no rows."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            out = fn(batch)
            if out is not None:
                yield out
    return df.mapInArrow(run, schema)


class WordValues(dict):
    """word -> value, computed on a miss.  Emptied when it holds ``limit`` words, so a
    worker's memory is bounded whatever the vocabulary."""

    def __init__(self, fn: Callable[[bytes], int], limit: int = 250_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.clear()
        v = self[word] = self.fn(word)
        return v


def hash64(word: bytes) -> int:
    """XXH64 with seed 42, as a signed 64-bit number (the value of Spark's ``xxhash64``)."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def values_of(words: list[bytes], cache: WordValues, dtype=np.int64) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=dtype, count=len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Combine two arrays of 64-bit hashes (order matters), wrapping."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C159E3779B9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
