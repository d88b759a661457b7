"""Groups of rows in plain Python: a partition's groups one after another, without a table of their own for each."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def once(value: Column) -> Column:
    """``value``, worked out where it stands: the optimizer does not move what counts as non-deterministic, as the partition number does, into lambdas or filters."""
    return F.when(F.spark_partition_id() >= 0, value)


def _rows(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple]:
    for b in batches:
        yield from map(kind._make, zip(*map(_values, b.columns)))


def _values(column: pa.Array) -> list:
    """``column.to_pylist()``, for flat columns by numpy, which is some times faster."""
    kind = column.type
    if pa.types.is_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _batches(out: Iterator[tuple], types: StructType) -> Iterator[pa.RecordBatch]:
    """Rows of ``types`` as batches of some thousand."""
    names, kinds, rows = [f.name for f in types], [_arrow(f.dataType) for f in types], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for r in out:
        rows.append(r)
        if len(rows) >= 5000:
            yield batch()
            rows = []
    if rows:
        yield batch()


def rows_as_batches(rows: list[tuple], types: StructType) -> Iterator[pa.RecordBatch]:
    """``rows`` of ``types`` as batches; a worker cannot read types from a text."""
    return _batches(iter(rows), types)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """``pa.array`` by flat columns, as nested values are slow one by one."""
    if pa.types.is_list(kind) and None not in values:
        flat = list(chain.from_iterable(values))
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), _column(flat, kind.value_type))
    if pa.types.is_struct(kind) and values and None not in values and isinstance(values[0], tuple):
        return pa.StructArray.from_arrays([_column(c, f.type) for c, f in zip(zip(*values), kind)], fields=list(kind))
    return pa.array(values, kind)


def map_groups(rows: DataFrame, keys: list[str], order: list[str], go: Callable[[list], list[tuple]], schema: str, partitions: int | None = None) -> DataFrame:
    """What ``go`` makes of every group of equal ``keys``, as rows of ``schema``.

    ``go`` gets the rows of a group as named tuples in the order of ``order``. Groups must be small (a page, a table); all of one
    task's are read in turn, so that small ones cost little. Rows that lie together by some of the keys already are not dealt out again.
    """
    types, names = StructType.fromDDL(schema), rows.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = namedtuple("Row", names)
        own = (b.select(names) for b in batches)
        yield from _batches((r for _, group in groupby(_rows(own, kind), key=itemgetter(*at)) for r in go(list(group))), types)

    if partitions:
        return rows.repartition(partitions, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
    # The window asks for the groups and their order, which Spark then only makes where the rows do not have them.
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*(order or keys)))
    return rows.withColumn("_number", number).mapInArrow(run, schema)


def map_rows(rows: DataFrame, go: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``go`` makes of a task's batches, as rows of ``schema``."""
    types = StructType.fromDDL(schema)
    return rows.mapInArrow(lambda batches: _batches(go(batches), types), schema)


def _arrow(kind: DataType) -> pa.DataType:
    if isinstance(kind, ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[kind.simpleString()]
