"""Whitening of embeddings with distributed block matrices.

Entries become whole numbers x = floor(64 * entry) + 1000000. The distinct x vectors are the fit list. Its rows, centred by
exact sums, are indexed into a BlockMatrix; transpose times matrix gives the scatter, one small matrix, whose
eigenvectors the driver finds; a second BlockMatrix product with the whitening matrix projects the rows.

How it scales. A product's inner dimension is dealt over tasks (``_BLOCKS`` blocks of rows each) and their small results
are summed, so no task reads more than its blocks. What reaches the driver is the sums, the size of each partition and
matrices of at most dimensions x dimensions. Copies are one row of the fit list, and rows meet their projection by a join
that deals out a vector with very many copies.

Cases: rows with a null vector or one with null or non-finite entries are left out, and so are vectors of another length
than the most frequent one (the shortest of these) and empty ones. A null ``vec_id`` and repeated rows come out like any.
Entries beyond 2**53 in x are taken as 2**53. ``deviation`` is null where it does not fit a long. A component without
variance (up to 10**-12 of the largest) has null ``whitened`` and counts for nothing in ``identity_error``, which is 0 if
there is no other. Equal eigenvalues: any basis of their space, the same for all rows. Other columns are dropped. An empty
table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import skew, spill

SCALE, SHIFT = 64, 1_000_000
_ROWS = 1024  # of a block
_BLOCKS = 4  # of rows in a task of a product
_FLAT = 1e-12


class Model(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # their unit vectors, in columns
    trace: float


def sound(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _whole(vector: str) -> Column:
    most = float(1 << 53)
    return F.transform(vector, lambda v: F.floor(F.greatest(F.least(SCALE * v, F.lit(most)), F.lit(-most))).cast("long") + SHIFT)


def indexed(rows: DataFrame) -> DataFrame:
    """``rows``, written to shared storage, with ``index`` from 0 without gaps. Numbers are given once, before writing, so a
    repeated task cannot change them; the driver sees the size of each partition."""
    held = spill.stash(rows.withColumn("nth", F.monotonically_increasing_id()))
    sizes = sorted((r[0], r[1]) for r in held.groupBy(F.shiftright("nth", 33)).count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    start = F.create_map(*(F.lit(v) for (part, _), b in zip(sizes, before, strict=False) for v in (part, b)))[F.shiftright("nth", 33)] if sizes else F.lit(0)
    return held.withColumn("index", (start + F.col("nth").bitwiseAND((1 << 33) - 1)).cast("long")).drop("nth")


def blocks(rows: DataFrame, n: int, width: int, high: int = _ROWS) -> BlockMatrix:
    """(index, array<double>) as a block matrix of n rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(rows.columns[1]).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(high, width)


def scatter(x: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, the inner dimension dealt over tasks."""
    splits = max(1, -(-x.numRowBlocks // _BLOCKS))
    product = x.transpose()._java_matrix_wrapper.call("multiply", x._java_matrix_wrapper._java_model, splits)
    found = BlockMatrix(product, x.colsPerBlock, x.colsPerBlock).toLocalMatrix().toArray()
    return (found + found.T) / 2


def projected(spark: SparkSession, x: BlockMatrix, by: np.ndarray) -> tuple[DataFrame, BlockMatrix]:
    """Rows times a small matrix, as (index, array<double>) and as blocks."""
    local = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(by)], "index long, row array<double>")
    product = x.multiply(blocks(local, *by.shape, high=len(by)))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").cast("long").alias("index"), vector_to_array("vector").alias("row")), product


def fit(centred: BlockMatrix, n: int, sums: list[int]) -> Model:
    values, vectors = np.linalg.eigh(scatter(centred) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return Model(n, sums, values, vectors, float(values.sum()))


def whiten(df: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row and each of the first ``most`` components: key, component, n, deviation, whitened, explained,
    identity_error."""
    spark = df.sparkSession
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("vec"))
    rows = rows.where(sound("vec")).where(F.size("vec") > 0)
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    d = length[0].d
    keys = lambda x: (F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(1), x).alias("k2"))
    rows = rows.where(F.size("vec") == d).select("id", _whole("vec").alias("x"))
    distinct = indexed(rows.groupBy("x").agg(F.count("*").alias("n"))).select("index", "x", "n", *keys("x"))
    each = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    n, sums = distinct.count(), [int(r.s) for r in sorted(each)]

    total = F.array(*(F.lit(str(s)) for s in sums)).cast("array<decimal(38,0)>")
    off = F.zip_with("x", total, lambda x, s: (x.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("decimal(38,0)"))
    square = F.aggregate("off", F.lit(0).cast("decimal(38,0)"), lambda a, v: F.try_add(a, F.try_multiply(v, v).cast("decimal(38,0)")).cast("decimal(38,0)"))
    held = distinct.withColumn("off", off)
    centred = blocks(held.select("index", F.transform("off", lambda v: v.cast("double") / n)), n, d)
    model = fit(centred, n, sums)

    r = min(most, d)
    live = int((model.values[:r] > _FLAT * max(model.values[0], 0)).sum())
    error = 0.0
    if live:
        by = model.vectors[:, :live] / np.sqrt(model.values[:live])
        points, product = projected(spark, centred, by)
        mean = np.array([x.m for x in sorted(points.select(F.posexplode("row")).groupBy("pos").agg(F.avg("col").alias("m")).collect())])
        error = float(np.abs(scatter(product) / n - np.outer(mean, mean) - np.eye(live)).max())
    else:
        points = distinct.select("index", F.array().cast("array<double>").alias("row"))
    share = F.array(*(F.lit(float(v / model.trace) if model.trace > 0 else 0.0) for v in model.values[:r]))
    found = held.withColumn("sq", square).select("index", "k1", "k2", F.expr("try_cast(sq AS long)").alias("deviation"))
    of_vector = found.join(points, "index").drop("index")
    met = skew.split_join(rows.select("id", *keys("x")), of_vector, ["k1", "k2"], distinct.select("k1", "k2", "n"), rows.count(), F.coalesce("id", F.lit(0)))
    out = met.select("id", "deviation", "row", F.posexplode(share).alias("pos", "explained"))
    return out.select(F.col("id").alias(key), (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.get("row", "pos").alias("whitened"), "explained", F.lit(error).alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
