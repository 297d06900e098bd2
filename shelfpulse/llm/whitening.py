"""Whitening of embeddings with MLlib block matrices.

An entry c becomes x = floor(64 c) + 1000000.  The fit list is every distinct x vector once.
Its rows, centred (exactly: (n x - S) / n in whole numbers before the one division), are
numbered without gaps and cut into the blocks of a ``BlockMatrix`` X.  X'X is a block product
whose middle dimension is split, so no task receives all blocks; it is of size
dimension x dimension and comes to the driver for ``eigh``.  The whitening matrix, eigenvectors
over roots of eigenvalues, is a small ``BlockMatrix`` again, and X times it projects the rows.
Rows of the input are joined to the projection of their x vector.

Rows whose vector is NULL or empty, or holds a NULL or non-finite entry, are dropped; so are
those with an entry beyond +-2**40, which no exact sums could carry, and vectors of another
length than the most frequent one (the longer one of two as frequent).  Repeated rows and NULL
ids are rows of their own.  An empty table gives no rows.  A component without variance (fewer
distinct vectors than dimensions, constant entries) has NULL in ``whitened``.  ``deviation`` is
NULL where it exceeds a long.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.llm.common import map_batches, saved

LARGEST = 2.0 ** 40              # of an entry; see above
COLUMNS = 1024                   # of a block


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int, shift: int) -> DataFrame:
    """vec_id, x of the rows that count."""
    def good(c):
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)
    kept = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("c")).filter(
        F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", good))
    # the bounds keep rows that are dropped from overflowing, whichever is worked out first
    bounded = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    x = F.transform("c", lambda c: F.floor(bounded(c) * scale).cast("long") + F.lit(shift).cast("long"))
    return kept.select("vec_id", x.alias("x"))


def numbered(fit: DataFrame) -> DataFrame:
    """Adds ``row``, numbers from 0 without gaps.  Places within a part file's task are known
    when it is written; what stands before a task is a sum over tasks."""
    placed = saved(fit.withColumn("at", F.monotonically_increasing_id()), "distinct")
    placed = placed.withColumn("task", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("task").agg(F.count("*").alias("n"))         # one row per task
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(start), "task").select((F.col("start") + F.col("at")).alias("row"), "x")


def centred(batch: pa.RecordBatch, n: int, sums: list[int]) -> pa.RecordBatch:
    """row, x, centred, deviation of (row, x)."""
    d = len(sums)
    x = batch.column(1).flatten().to_numpy().reshape(-1, d)
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
    exact = np.int64 if 2 * n * largest < 2 ** 62 else object           # whole numbers of any size
    off = x.astype(exact) * n - np.array(sums, dtype=exact)
    widest = max((abs(int(v)) for v in (off.max(), off.min())), default=0) if off.size else 0
    wide = off if d * widest ** 2 < 2 ** 62 else off.astype(object)
    deviation = [int(v) if v < 2 ** 63 else None for v in (wide ** 2).sum(axis=1).tolist()]
    values = pa.array((off / n).astype(np.float64).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, d, dtype=np.int32)), values)
    return pa.RecordBatch.from_arrays([*batch.columns[:2], lists, pa.array(deviation, pa.int64())],
                                      ["row", "x", "centred", "deviation"])


def gram(m: BlockMatrix, splits: int) -> np.ndarray:
    """m'm, with the middle dimension of the product in ``splits`` parts."""
    # multiply(other, numMidDimSplits) is public in Scala; Python's multiply has no such argument
    t = m.transpose()._java_matrix_wrapper
    product = BlockMatrix(t.call("multiply", m._java_matrix_wrapper._java_model, splits), m.colsPerBlock, m.colsPerBlock)
    return product.toLocalMatrix().toArray()


def components_of(scatter: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitening matrix (0 where there is no variance), share of the trace, and whether there
    is variance, for the k first components; the largest entry of each is positive."""
    e, u = np.linalg.eigh((scatter + scatter.T) / 2)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    real = e > len(scatter) * np.finfo(float).eps * max(e[0], 0)
    trace = np.trace(scatter)
    share = np.where(real, e, 0) / trace if trace > 0 else np.zeros(k)
    return np.where(real, u / np.sqrt(np.where(real, e, 1)), 0), share, real


def block_rows(block, rows_per_block: int):
    """(row, values) of a block that holds whole rows."""
    (i, _), m = block
    return [(i * rows_per_block + r, values) for r, values in enumerate(m.toArray().tolist())]


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16,
             scale: int = 64, shift: int = 1_000_000, rows_per_block: int = 4096) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per kept
    input row and component."""
    spark = rows.sparkSession
    members = whole_vectors(rows, vec_id, vector, scale, shift)
    widths = members.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = widths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], RESULT)
    d = most["d"]
    members = members.filter(F.size("x") == d)
    fit = numbered(members.select("x").distinct())
    sums = (fit.select(F.posexplode("x").alias("i", "v")).groupBy("i")
            .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect())    # d rows
    n, totals = sums[0]["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]
    fit = saved(map_batches(fit.select("row", "x"), partial(centred, n=n, sums=totals),
                            "row long, x array<long>, centred array<double>, deviation long"), "centred")

    k = min(components, d)
    columns = min(d, COLUMNS)
    indexed = fit.select(F.col("row").alias("index"), array_to_vector("centred").alias("vector"))
    x = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(indexed, "vector"), n, d).toBlockMatrix(rows_per_block, columns)
    splits = max(1, min(-(-n // rows_per_block), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    matrix, share, real = components_of(gram(x, splits) / n, k)
    blocks = [((i, 0), DenseMatrix(len(part), k, part.ravel(order="F").tolist()))
              for i, part in enumerate(matrix[a:a + columns] for a in range(0, d, columns))]
    projected = x.multiply(BlockMatrix(spark.sparkContext.parallelize(blocks), columns, k, d, k))
    inside = real[:, None] & real[None, :]
    error = float(np.abs(np.where(inside, gram(projected, splits) / n - np.eye(k), 0)).max())

    values = saved(spark.createDataFrame(projected.blocks.flatMap(partial(block_rows, rows_per_block=rows_per_block)),
                                         "row long, w array<double>"), "projected")
    by_vector = fit.select("row", "x", "deviation").join(values, "row").drop("row")
    per = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(float(share[i])).alias("explained"),
                             F.lit(bool(real[i])).alias("real")) for i in range(k)])
    return (members.join(by_vector, "x")
            .select("vec_id", "deviation", F.posexplode("w").alias("i", "w"))
            .select("vec_id", "deviation", "w", F.get(per, F.col("i")).alias("c"))
            .select(F.col("vec_id").cast("long").alias("vec_id"), "c.component", F.lit(n).cast("long").alias("n"), "deviation",
                    F.when(F.col("c.real"), F.col("w")).alias("whitened"), "c.explained",
                    F.lit(error).alias("identity_error")))
