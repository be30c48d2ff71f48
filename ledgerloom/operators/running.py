"""Ordered calculations per key, as a parallel prefix scan.

A plain window per key sends the whole key to one task. Here all rows are dealt once, by ranges of key and order, so one key
may be spread over all tasks. A task runs over its own sorted rows in Arrow batches, and its last row tells where it ended. Both
are written to the shared folder: the ranges must not be dealt anew between the two steps. What the rows of
a range's first key take over from earlier ranges then comes from a table with one row per range, which is
broadcast: it is as long as there are partitions, however many rows there are.

The order columns should end in a unique one; rows that are equal in all of them stay in one range.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DecimalType, LongType, StructField, StructType

from ledgerloom.session import fresh_dir

# Workers receive these functions themselves, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VALUE, _RANGE = "_value", "_range"
_LIMIT = 9.2e18


def _sorted(columns: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]


class _Keys:
    """Finds where a new key begins, across the batches of a partition."""

    def __init__(self, names: list[str]):
        self.names, self.last = names, None

    def begins(self, batch: pa.RecordBatch) -> np.ndarray:
        n, found = batch.num_rows, np.zeros(batch.num_rows, dtype=bool)
        first = [batch.column(k)[0].as_py() for k in self.names]
        found[0] = first != self.last
        for name in self.names:
            column = batch.column(name)
            before, here = column.slice(0, n - 1), column.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(pc.is_null(here), pc.is_null(before)))
            found[1:] |= ~same.to_numpy(zero_copy_only=False)
        self.last = [batch.column(k)[n - 1].as_py() for k in self.names]
        return found


class _Sums:
    """Sums and counts of values within each key; the state is that of the last key."""

    def __init__(self):
        self.total = self.count = self.seen = 0

    def rows(self, batch: pa.RecordBatch, begins: np.ndarray) -> tuple[dict[str, pa.Array], np.ndarray]:
        """New columns, and the rows that earlier ranges add to: all of the range's first key."""
        values = batch.column(_VALUE)
        numbers = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        if np.abs(np.cumsum(numbers, dtype=float)).max() + abs(float(self.total)) > _LIMIT:
            raise OverflowError("a running sum leaves the range of 64 bits")
        sums = self._within(numbers, begins, self.total)
        counts = self._within(pc.is_valid(values).to_numpy(zero_copy_only=False).astype(np.int64), begins, self.count)
        self.total, self.count = int(sums[-1]), int(counts[-1])
        open_to = self.seen + np.cumsum(begins) <= 1
        self.seen += int(begins.sum())
        return {"_total": pa.array(sums), "_count": pa.array(counts)}, open_to

    def state(self) -> dict[str, pa.Array]:
        return {"_state_total": pa.array([self.total]), "_state_count": pa.array([self.count])}

    @staticmethod
    def _within(numbers: np.ndarray, begins: np.ndarray, carried: int) -> np.ndarray:
        running = np.cumsum(numbers)
        bases = np.concatenate([[-carried], (running - numbers)[begins]])
        return running - bases[np.cumsum(begins)]


class _Before:
    """The value of the row before, within each key; the state is the last row's value."""

    def __init__(self, value: str):
        self.value, self.last = value, None

    def rows(self, batch: pa.RecordBatch, begins: np.ndarray) -> tuple[dict[str, pa.Array], np.ndarray]:
        """New columns, and the rows that earlier ranges add to: the range's first."""
        values, n = batch.column(self.value), batch.num_rows
        open_to = np.zeros(n, dtype=bool)
        open_to[0] = self.last is None
        earlier = pa.concat_arrays([pa.nulls(1, values.type) if self.last is None else self.last, values.slice(0, n - 1)])
        self.last = values.slice(n - 1)
        return {"_earlier": pc.if_else(pa.array(begins), pa.scalar(None, values.type), earlier)}, open_to

    def state(self) -> dict[str, pa.Array]:
        return {"_state_value": self.last}


def _scanned(df: DataFrame, keys: list[str], order: list[str], descending: bool, step: Callable[[], _Sums | _Before],
             new: list[StructField], state: list[StructField]) -> tuple[DataFrame, DataFrame]:
    """The rows with their new columns, and for each range its first row, its last key and its state at the end."""
    spark = df.sparkSession
    by = [*_sorted(keys, False), *_sorted(order, descending)]
    rows = df.withColumn(_RANGE, F.xxhash64(*keys, *order)).repartitionByRange(*by).sortWithinPartitions(*by)
    last = [StructField(f"_last_{k}", rows.schema[k].dataType) for k in keys]
    names = [f.name for f in (*new, *last, *state)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, steps, head, tail = _Keys(keys), step(), None, None

        def out(batch: pa.RecordBatch, added: dict[str, pa.Array], of: pa.Array, at_end: bool) -> pa.RecordBatch:
            filled = [added.get(name, pa.nulls(batch.num_rows)) for name in names]
            return pa.RecordBatch.from_arrays([*batch.columns, *(f.cast(kind) for f, kind in zip(filled, kinds)), of,
                                               pa.array([at_end] * batch.num_rows)], [*batch.schema.names, *names, "_of", "_end"])

        for batch in batches:
            if batch.num_rows:
                if head is None:
                    head, digest = batch.slice(0, 1), batch.column(_RANGE)[0].as_py()
                added, open_to = steps.rows(batch, where.begins(batch))
                yield out(batch, added, pa.array(np.full(batch.num_rows, digest), mask=~open_to), False)
                tail = batch.slice(batch.num_rows - 1)
        if head is not None:
            ended = {f"_last_{k}": tail.column(k) for k in keys} | steps.state()
            yield out(head, ended, pa.array([digest]), True)

    schema = StructType([*rows.schema.fields, *new, *last, *state, StructField("_of", LongType()), StructField("_end", BooleanType())])
    kinds = to_arrow_schema(StructType([*new, *last, *state])).types
    path = fresh_dir(spark, "ordered")
    rows.mapInArrow(scan, schema).write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    return written.filter("NOT _end"), written.filter("_end")


def _carried(ranges: DataFrame, keys: list[str], order: list[str], descending: bool, wanted: list[Column]) -> DataFrame:
    """One row per range: what the earlier ranges hold of its first key."""
    first = F.struct(*[F.col(k).alias(k) for k in keys], F.lit(0).alias("_side"))
    last = F.struct(*[F.col(f"_last_{k}").alias(k) for k in keys], F.lit(1).alias("_side"))
    sides = ranges.withColumns({f"_by_{k}": F.col(k) for k in keys}).withColumn("_s", F.explode(F.array(first, last))).select(
        *[F.col(f"_s.{k}").alias(k) for k in keys], F.col("_s._side").alias("_side"), *[f"_by_{k}" for k in keys], *order,
        "_of", *[c for c in ranges.columns if c.startswith("_state")])
    before = Window.partitionBy(*keys).orderBy(
        *_sorted([f"_by_{k}" for k in keys], False), *_sorted(order, descending), "_side").rowsBetween(Window.unboundedPreceding, -1)
    return sides.select("_side", "_of", *[c.over(before).alias(f"_before_{i}") for i, c in enumerate(wanted)]).filter(
        "_side = 0").drop("_side")


def _ended(value: Column) -> Column:
    return F.when(F.col("_side") == 1, value)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, descending: bool = False) -> DataFrame:
    """Add ``out``: the sum of ``value`` (whole numbers or decimals) over the key's rows up to and including this one."""
    kind = df.select(value).schema[0].dataType
    scale = kind.scale if isinstance(kind, DecimalType) else 0
    whole = (value.cast(DecimalType(38, scale)) * F.lit(10 ** scale)).cast("long") if scale else value.cast("long")
    rows, ranges = _scanned(df.withColumn(_VALUE, whole), keys, order, descending, _Sums,
                            [StructField("_total", LongType()), StructField("_count", LongType())],
                            [StructField("_state_total", LongType()), StructField("_state_count", LongType())])
    carried = _carried(ranges, keys, order, descending, [F.sum(_ended(F.col("_state_total").cast("decimal(38,0)"))),
                                                         F.sum(_ended(F.col("_state_count")))])
    total = F.col("_total").cast("decimal(38,0)") + F.coalesce("_before_0", F.lit(Decimal(0)))
    result = (total * F.lit(Decimal(1).scaleb(-scale))).cast(DecimalType(min(kind.precision + 10, 38), scale)) if scale else total.cast("long")
    return rows.join(F.broadcast(carried), "_of", "left").withColumn(
        out, F.when(F.col("_count") + F.coalesce("_before_1", F.lit(0)) > 0, result)).select(*df.columns, out)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str, descending: bool = False) -> DataFrame:
    """Add ``out``: the 1-based position of the row within its key."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, descending)


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the key's preceding row, null on its first."""
    kind = df.schema[value].dataType
    rows, ranges = _scanned(df, keys, order, False, lambda: _Before(value), [StructField("_earlier", kind)], [StructField("_state_value", kind)])
    carried = _carried(ranges, keys, order, False, [F.last(_ended(F.struct(F.col("_state_value").alias("v"))), ignorenulls=True)])
    return rows.join(F.broadcast(carried), "_of", "left").withColumn(
        out, F.coalesce("_earlier", F.col("_before_0.v"))).select(*df.columns, out)
