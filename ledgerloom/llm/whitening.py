"""Whiten embeddings along the leading eigenvectors of their covariance.

Spark sums the integer vectors exactly, then their products about the mean: each task sends one matrix of
dimension by dimension, and tasks add those up row by row. Only that matrix, whose size does not
depend on the number of vectors, comes to the driver, where ``spectrum`` slices its spectrum. The vectors are then
projected where they are read. There is no shuffle of vectors; a task holds one Arrow batch of them.

Defined results: a vector is left out if it is null, has a null, non-finite or (beyond 2^40) not exactly
scalable entry, or another length than most vectors have (of equally frequent lengths the largest); fewer dimensions than
components give a component each; components without variance are left out, as nothing can whiten them; a deviation that no
long can hold is null; rows with the same id are separate rows; an empty table gives no rows. Only the id and vector columns are read,
so other columns may have any name.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ledgerloom.llm import spectrum
from ledgerloom.llm.text import saved

# Workers receive these functions themselves, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0 ** 40


class Fit(NamedTuple):
    """What the fit list is: vectors, whole and remaining parts of the mean times n, eigenvalues and unit eigenvectors."""

    n: int
    mean: np.ndarray  # whole part
    rest: np.ndarray  # sum = n * mean + rest
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def _entry(c: Column) -> Column:
    return (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long")


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    read = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    # A comparison with null or not-a-number is never true here.
    return read.filter(F.size("vector") > 0).filter(
        F.forall("vector", lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST)))


def _offsets(batch: pa.RecordBatch, fit_mean: np.ndarray) -> np.ndarray:
    """The integer vectors of a batch less the whole part of the mean."""
    entries = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(entries * SCALE).astype(np.int64) + SHIFT).reshape(batch.num_rows, -1) - fit_mean


def _summed(vectors: DataFrame, values_of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of the products of every two of a row's ``size`` values."""
    schema = pa.schema([("i", pa.int32()), ("products", pa.list_(pa.float64()))])

    def rows_of(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"i": list(total), "products": [v.tolist() for v in total.values()]}, schema)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            values = values_of(batch)
            total += values.T @ values
        yield rows_of(dict(enumerate(total)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = row.values.to_numpy()
                total[i] = total[i] + row if i in total else row
        yield rows_of(total)

    parts = vectors.mapInArrow(products, "i int, products array<double>")
    rows = parts.repartition("i").mapInArrow(added, "i int, products array<double>").collect()
    return np.array([r.products for r in sorted(rows, key=lambda r: r.i)])


def fit(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Eigenvalues and eigenvectors of the covariance of usable vectors; None if there are none."""
    entries = vectors.select(F.size("vector").alias("length"), F.posexplode("vector").alias("i", "c"))
    sums = saved(entries.groupBy("length", "i").agg(F.sum(_entry(F.col("c"))).alias("total"), F.count(F.lit(1)).alias("n")),
                 spark, "whitening-sums")
    most = sums.filter("i = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not most:
        return None
    n, length = most[0].n, most[0].length
    totals = [r.total for r in sums.filter(F.col("length") == length).orderBy("i").collect()]
    mean = np.array([t // n for t in totals])
    rest = np.array([t % n for t in totals])

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return _offsets(batch, mean) - rest / n

    covariance = _summed(vectors.filter(F.size("vector") == length), centred, length) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, found = spectrum.leading(covariance, components)
    kept = values > length * np.finfo(float).eps * trace
    return Fit(n, mean, rest, trace, values[kept], found[kept])


def _projected(batch: pa.RecordBatch, model: Fit) -> np.ndarray:
    return (_offsets(batch, model.mean) - model.rest / model.n) @ (model.vectors / np.sqrt(model.values)[:, None]).T


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    k = len(model.values)
    if k == 0:
        return 0.0

    def with_one(batch: pa.RecordBatch) -> np.ndarray:
        return np.hstack([_projected(batch, model), np.ones((batch.num_rows, 1))])

    moments = _summed(vectors, with_one, k + 1) / model.n
    # The vectors are centred already; what is left of their mean is rounding.
    covariance = moments[:k, :k] - np.outer(moments[k, :k], moments[k, :k])
    return float(np.abs(covariance - np.eye(k)).max())


def _deviations(offsets: np.ndarray, model: Fit) -> pa.Array:
    about = model.n * offsets.astype(np.float64) - model.rest
    fits = (about ** 2).sum(axis=1) < 2.0 ** 63 * (1 - 1e-9)
    exact = np.where(fits[:, None], offsets, 0) * model.n - np.where(fits[:, None], model.rest, 0)
    return pa.array((exact ** 2).sum(axis=1), mask=~fits)


def whiten(spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the whitened value, the component's share of the variance, and the vector's deviation."""
    usable = _usable(vectors, id_col, vector_col)
    out = StructType([
        StructField("vec_id", usable.schema["vec_id"].dataType), StructField("component", IntegerType()), StructField("n", LongType()),
        StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
        StructField("identity_error", DoubleType())])
    model = fit(spark, usable, components)
    if model is None:
        return spark.createDataFrame([], out)
    fitted = usable.filter(F.size("vector") == len(model.mean))
    error, k, schema = identity_error(fitted, model), len(model.values), to_arrow_schema(out)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated = pa.array(np.repeat(np.arange(batch.num_rows), k))
            many = len(repeated)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(many, model.n)), _deviations(_offsets(batch, model.mean), model).take(repeated),
                pa.array(_projected(batch, model).ravel()), pa.array(np.tile(model.values / model.trace, batch.num_rows)),
                pa.array(np.full(many, error))], schema=schema)

    return fitted.mapInArrow(whitened, out)
