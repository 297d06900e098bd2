"""Best-fit packing planned on the histogram of lengths.

Tokens.  A document is its ids and an end id.  A longer one than ``capacity`` is cut into
pieces of ``capacity`` tokens, the first of which may be shorter.

Plan.  Pieces are counted per length (at most ``capacity`` rows reach the driver) and
best-fit decreasing runs over these counts: for each length, longest first, open sequences
are taken by remaining room, least first; all sequences with equal history are handled at
once.  A plan row says that so many sequences from a number on take so many pieces of a
length each at an offset; the plan's size depends on ``capacity`` only.

Slots.  Within a length, pieces are ranked (by a hash bucket of the piece, then by doc_id
and piece), and rank r takes the r-th planned slot of that length.  Ranks come from bucket
counts and a window per (length, bucket), so a length that holds most rows is spread over
many tasks.

NULL text counts as empty (one piece: the end id).  Repeated rows are packed each on
their own; NULL ids are packed like others.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.llm import token_counts, tokenizer
from shelfpulse.llm.common import map_batches, saved


# the split pattern looks back over a run of blanks sign by sign, which overflows the stack of
# the encoder at some hundred thousand; the compiled machine does not
LONG_BLANK = re.compile(r"\s{1000}")


def ids_of(vocabulary: str, text: str) -> list[int]:
    if LONG_BLANK.search(text):
        return token_counts.machine(vocabulary).ids(text)
    return tokenizer.encode(tokenizer.encoding(vocabulary), text)


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.array([*ids_of(vocabulary, text or ""), end_id], dtype="<u4")
            n = len(ids)
            cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                rows.append((doc_id, i, a, b - a, zlib.crc32(memoryview(ids[a:b]).cast("B"))))
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                          ["doc_id", "piece", "start", "length", "ids_crc32"])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                       "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns rows (length, first rank, sequences, pieces in each, first sequence, offset): the
    pieces of that length with ranks from ``first rank`` on go to ``sequences`` consecutive
    sequences, ``pieces in each``, from ``offset`` on.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}      # remaining room -> (first sequence, how many)
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, n: int, free: int) -> list[tuple[int, int, int]]:
            """Fill n sequences with ``free`` room; returns what is open afterwards."""
            nonlocal left, rank
            each = free // length
            full = min(n, left // each)
            after = []
            if full:
                rows.append((length, rank, full, each, first, capacity - free))
                rank, left = rank + full * each, left - full * each
                after.append((free - each * length, first, full))
            if full < n and left:                    # the last few pieces, in one sequence
                rows.append((length, rank, 1, left, first + full, capacity - free))
                after.append((free - left * length, first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                after.append((free, first + full, n - full))
            return after

        for free in sorted(r for r in room if r >= length):
            if not left:
                break
            for first, n in room.pop(free):
                for r, f, k in (put(first, n, free) if left else [(free, first, n)]):
                    room.setdefault(r, []).append((f, k))
        if left:
            n = math.ceil(left / (capacity // length))
            for r, f, k in put(opened, n, capacity):
                room.setdefault(r, []).append((f, k))
            opened += n
        room.pop(0, None)
    return rows


def ranked(made: DataFrame, histogram: dict[int, int], rows_per_bucket: int = 1_000) -> DataFrame:
    """Adds rank (from 0, without gaps) within each length.  A length has as many buckets
    as its count asks for."""
    buckets = made.sparkSession.createDataFrame(
        [(k, math.ceil(n / rows_per_bucket)) for k, n in histogram.items()], "length long, buckets int")
    rows = (made.join(F.broadcast(buckets), "length")       # one row per length, capacity at most
            .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = (sizes.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
              .drop("n"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (rows.withColumn("r", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
            .withColumn("rank", F.col("base") + F.col("r")).drop("bucket", "buckets", "base", "r"))


def packed(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    made = saved(pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    shared = made.sparkSession.sparkContext.broadcast(steps)      # bounded by capacity, not by documents

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        step = shared.value
        length, rank = (batch.column(i).to_numpy() for i in (3, 5))
        big = np.int64(1) << 40
        at = np.searchsorted(step[:, 0] * big + step[:, 1], length * big + rank, side="right") - 1
        inside, each = rank - step[at, 1], step[at, 3]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(step[at, 4] + inside // each),
             pa.array(step[at, 5] + inside % each * length)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return map_batches(ranked(made, counts).select(*cols), run,
                       "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
