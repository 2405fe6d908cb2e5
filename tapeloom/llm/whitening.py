"""PCA whitening of embeddings on distributed block matrices.

Rows are centred from exact integer sums and numbered by task, so that each task's rows fill blocks of
their own and no join or sort is needed to number them.  The transposed block matrix times itself is the
scatter, whose eigenvectors (a d x d problem, solved on the driver) make the whitening matrix, and the
block matrix times that matrix projects every row.  The middle dimension of the scatter product is split,
so partial products of a few blocks are summed by many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import pick, stage
from tapeloom.llm.vectors import complete, of_common_length, scaled

COMPONENTS = 32
LARGEST = float(2**40)  # entries beyond it, times 64, are not exact as double
BLOCK_ROWS = 16384  # at most, in a block
BLOCK_ENTRIES = 1 << 20  # likewise; while a block is put together each entry takes some 24 bytes
MATRIX_BLOCKS = 4096  # at most, in one product: its plan is made on the driver block by block
SPLIT_BLOCKS = 4  # blocks whose products one task sums
RANK_TOLERANCE = 1e-12  # eigenvalues of less than this share of the largest count as zero

SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def _product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a b, the middle dimension dealt to ``splits`` groups of tasks."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def _blocks(rows: DataFrame, height: int, width: int, block_rows: int) -> BlockMatrix:
    """(index, values) rows as a block matrix; indexes without a row are zero rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")))
    return IndexedRowMatrix(vectors, height, width).toBlockMatrix(block_rows, width)


def _indexed(matrix: BlockMatrix) -> DataFrame:
    """(index, values) of the rows of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows).select("index", vector_to_array("vector").alias("values"))


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    splits = max(1, matrix.numRowBlocks // SPLIT_BLOCKS)
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def whiten(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = 64, offset: int = 1_000_000, block_rows: int = BLOCK_ROWS, matrix_blocks: int = MATRIX_BLOCKS,
) -> DataFrame:
    """The first ``components`` whitened coordinates of every row, with the figures of the fit.

    Entries c count as x = floor(scale * c) + offset.  ``n`` is the number of rows fitted, ``deviation``
    the exact sum over dimensions of (n x - S)^2, null where that does not fit a long; ``explained`` the
    share of a component in the variance; ``identity_error`` the largest absolute entry of the whitened
    rows' covariance less the identity.

    A null vector, or one with a null, NaN, infinite entry or one beyond ``LARGEST``, is left out, as are
    vectors of another length than the most frequent.  Components without variance (equal rows, one row,
    fewer rows or dimensions than components) have no rows.  A null id stays null, repeated rows count
    and come back as often as they are there, other columns are not read, no rows give no rows.
    """
    spark = df.sparkSession
    whole = pick(df, vec_id=vec_id, v=vector).where(complete(F.col("v"), LARGEST))
    whole, width = of_common_length(whole, "v")
    if not width:
        return spark.createDataFrame([], SCHEMA)
    kept = whole.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(F.col("v"), scale, offset).alias("x"))
    kept = stage(kept.withColumn("row", F.monotonically_increasing_id()))

    sums = dict(kept.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col")).collect())  # one row a dimension
    task = F.shiftright("row", 33)
    sizes = kept.groupBy(task.alias("task")).count()
    n, tasks, most = sizes.agg(F.sum("count"), F.max("task") + 1, F.max("count")).first()
    block_rows = max(1, min(block_rows, most, BLOCK_ENTRIES // width))
    stride = -(-most // block_rows)  # blocks a task
    total = F.array(*[F.lit(int(sums[i])).cast("bigint") for i in range(width)])
    exact = F.transform("x", lambda x, i: F.lit(n).cast("bigint") * x - F.get(total, i))
    index = task * F.lit(stride * block_rows).cast("bigint") + F.col("row").bitwiseAND(2**33 - 1)
    rows = stage(kept.select("vec_id", "row", index.alias("index"), exact.alias("exact")).select(
        "vec_id", "index", F.transform("exact", lambda e: e.cast("double") / float(n)).alias("values"),
        F.aggregate("exact", F.lit(0).cast("bigint"), lambda a, e: F.try_add(a, F.try_multiply(e, e))).alias("deviation"),
    ))

    step = matrix_blocks * block_rows
    slices = range(0, tasks * stride * block_rows, step)
    matrices = []
    for low in slices:  # one, up to matrix_blocks x block_rows rows
        part = rows.where(F.col("index").between(low, low + step - 1)).withColumn("index", F.col("index") - low)
        height = min(step, tasks * stride * block_rows - low)
        matrices.append(_blocks(part, height, width, block_rows))
    covariance = sum(_scatter(m) for m in matrices) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = int((values[:components] > RANK_TOLERANCE * max(values[0], 0)).sum())
    if not found:
        return spark.createDataFrame([], SCHEMA)
    matrix = vectors[:, :found] / np.sqrt(values[:found])
    local = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "index bigint, values array<double>")
    projection = _blocks(local, width, found, width)
    projected = [_product(m, projection, 1) for m in matrices]
    error = float(np.abs(sum(_scatter(m) for m in projected) / n - np.eye(found)).max())

    shares = F.array(*[F.lit(float(v)) for v in values[:found] / values.sum()])
    coordinates = [_indexed(m).withColumn("index", F.col("index") + low) for low, m in zip(slices, projected, strict=True)]
    whitened = coordinates[0]
    for more in coordinates[1:]:
        whitened = whitened.unionAll(more)
    return (
        rows.select("vec_id", "index", "deviation").join(whitened, "index")
        .select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
            "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
