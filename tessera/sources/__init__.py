"""Arrays from tables, array columns, local data and sparse formats."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.array import LazyArray
from tessera.dtypes import from_spark, spark_type, to_type
from tessera.plans.compile import dims
from tessera.plans.nodes import Source

SHARE = 4 << 20  # bytes of tables for each task that validates an array over them
MOST_TASKS = 1 << 16


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_table(df: DataFrame, coordinates: Sequence[str | Column], value: str | Column, shape: Sequence[int], dtype=None, sparse: bool = True, masked: bool = False, aggregate: str | None = None) -> LazyArray:
    """An array whose cells are rows of ``df``: a column for each dimension, and the value
    (NULL: masked). ``sparse``: cells without a row are zero; else there must be a row for
    each. Coordinates must be unique, or ``aggregate`` says how rows of a cell become
    one: sum, count, min, max, avg."""
    keys = [_column(c).cast("long").alias(d) for c, d in zip(coordinates, dims(len(coordinates)), strict=True)]
    if len(keys) != len(shape):
        raise ValueError(f"{len(keys)} coordinates for {len(shape)} dimensions")
    cells = df.select(*keys, _column(value).alias("v"))
    if aggregate:
        made = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}[aggregate]("v")
        cells = cells.groupBy(*dims(len(shape))).agg(made.alias("v"))
    dtype = np.dtype(dtype) if dtype is not None else from_spark(cells.schema["v"].dataType.simpleString())
    typed = cells.withColumn("v", to_type(F.col("v"), dtype)) if cells.schema["v"].dataType.simpleString() != spark_type(dtype) else cells
    chunks = (shape[0], *[1] * (len(shape) - 1)) if sparse and shape else tuple(shape)
    return LazyArray(Source(lambda subset: typed, tuple(map(int, shape)), dtype, sparse, masked, chunks, 1.5 if sparse else 1.0, df))


def from_array_column(df: DataFrame, row: str | Column, values: str | Column, shape: Sequence[int], dtype=None, masked: bool = False) -> LazyArray:
    """A dense matrix with a row of ``df`` for each of its rows: ``row`` its number, ``values``
    an array. A range of columns is cut out of the arrays before they are taken apart."""
    rows, width = map(int, shape)
    element = df.select(_column(values).alias("v")).schema["v"].dataType.elementType.simpleString()
    dtype = np.dtype(dtype) if dtype is not None else from_spark(element)

    def cells(subset) -> DataFrame:
        part, start = F.col("_values"), 0
        columns = subset[1] if subset else None
        if columns is not None and columns.step > 0:
            start = columns[0]
            part = F.slice(part, start + 1, columns[-1] - start + 1)
        table = df.select(_column(row).cast("long").alias("d0"), _column(values).alias("_values"))
        if subset and subset[0] is not None:
            table = table.where((F.col("d0") >= subset[0][0]) & (F.col("d0") <= subset[0][-1]))
        made = table.select("d0", F.posexplode(part).alias("p", "v"))
        return made.select("d0", (F.col("p") + start).cast("long").alias("d1"), to_type(F.col("v"), dtype).alias("v"))

    return LazyArray(Source(cells, (rows, width), dtype, False, masked, (1, width), 1.0, df))


def _local(spark: SparkSession, columns: dict[str, np.ndarray], value: np.ndarray, mask: np.ndarray | None) -> DataFrame:
    if value.dtype.kind == "u":
        value = value.astype(object if value.dtype.itemsize == 8 else np.int64)
    if value.dtype == np.float16:
        value = value.astype(np.float32)
    table = {k: pa.array(np.asarray(v, np.int64)) for k, v in columns.items()}
    if value.dtype == object:
        table["v"] = pa.array([None if mask is not None and mask[k] else int(x) for k, x in enumerate(value)], pa.decimal128(20, 0))
    else:
        table["v"] = pa.array(value, mask=mask)
    return spark.createDataFrame(pa.table(table)) if len(value) else spark.createDataFrame([], ", ".join(f"`{k}` long" for k in columns) + ", v " + spark_type("float64" if value.dtype == object else value.dtype))


def from_numpy(spark: SparkSession, values) -> LazyArray:
    """A local array, masked or not, of any rank; its size is the driver's."""
    values = np.asanyarray(values)
    data, mask = np.ma.getdata(values), np.ma.getmaskarray(values) if isinstance(values, np.ma.MaskedArray) else None
    places = np.indices(values.shape).reshape(values.ndim, -1) if values.ndim else np.zeros((0, 1))
    df = _local(spark, dict(zip(dims(values.ndim), places)), data.ravel(), None if mask is None else mask.ravel())
    typed = df.withColumn("v", to_type(F.col("v"), values.dtype))
    chunks = tuple(1 if k < values.ndim - 1 else n for k, n in enumerate(values.shape))
    return LazyArray(Source(lambda subset: typed, values.shape, values.dtype, False, mask is not None, chunks, 1.0, values))


def from_coordinates(spark: SparkSession, shape: Sequence[int], coordinates: Sequence[np.ndarray], values, cost: float = 1.5, chunks: Sequence[int] | None = None) -> LazyArray:
    """A sparse array of local coordinates (one vector for each dimension) and values."""
    values = np.asanyarray(values)
    mask = np.ma.getmaskarray(values) if isinstance(values, np.ma.MaskedArray) else None
    df = _local(spark, dict(zip(dims(len(shape)), coordinates)), np.ma.getdata(values), mask)
    typed = df.withColumn("v", to_type(F.col("v"), values.dtype))
    return LazyArray(Source(lambda subset: typed, tuple(map(int, shape)), values.dtype, True, mask is not None, tuple(chunks or (shape[0], *[1] * (len(shape) - 1))), cost, values))


def from_csc(spark, shape, indptr, indices, values) -> LazyArray:
    columns = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    return from_coordinates(spark, shape, [np.asarray(indices), columns], values, 1.5, (shape[0], 1))


def from_csr(spark, shape, indptr, indices, values) -> LazyArray:
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    return from_coordinates(spark, shape, [rows, np.asarray(indices)], values, 1.5, (1, shape[1]))


def from_coo(spark, shape, rows, columns, values) -> LazyArray:
    return from_coordinates(spark, shape, [np.asarray(rows), np.asarray(columns)], values, 5.0, shape)


def from_sparse_matrix(spark: SparkSession, matrix) -> LazyArray:
    """A sparse array of a matrix object that has ``format`` and ``shape`` and the vectors of
    its format: indptr, indices and data (csc, csr), or row, col and data (coo)."""
    if matrix.format == "coo":
        made, own = from_coo(spark, matrix.shape, matrix.row, matrix.col, matrix.data), matrix.row
    else:
        made, own = {"csc": from_csc, "csr": from_csr}[matrix.format](spark, matrix.shape, matrix.indptr, matrix.indices, matrix.data), matrix.indices
    made.node.pristine, made.node.index_dtype = matrix, np.asarray(own).dtype
    return made


def sparse_ndarray(spark: SparkSession, shape: Sequence[int], contents, dtype=None, index_dtype=None, is_masked: bool | None = None, check: bool = True) -> LazyArray:
    """A sparse array from nested lists: the outermost list runs along the last dimension,
    leaves are (indices, values) along the first, None stands for a part without
    values. Types and mask are read from the leaves unless given."""
    shape = tuple(map(int, shape))
    leaves: list[tuple[tuple[int, ...], np.ndarray, np.ndarray]] = []

    def walk(part, level: int, place: tuple[int, ...]):
        if part is None:
            return
        if level == 0:
            indices, values = np.asarray(part[0]), np.asanyarray(part[1])
            if check:
                if len(indices) != len(values):
                    raise ValueError("a leaf's indices and values differ in number")
                if len(indices) and (indices[0] < 0 or indices[-1] >= shape[0] or (np.diff(indices.astype(np.int64)) <= 0).any()):
                    raise ValueError("a leaf's indices must increase and lie in the first dimension")
            leaves.append((place, indices, values))
            return
        if check and len(part) != shape[level]:
            raise ValueError(f"{len(part)} parts for an extent of {shape[level]}")
        for k, below in enumerate(part):
            walk(below, level - 1, (k, *place))

    walk(contents, len(shape) - 1, ())
    if dtype is None:
        if not leaves:
            raise ValueError("an array without values needs a dtype")
        dtype = leaves[0][2].dtype
    if check and any(v.dtype != np.dtype(dtype) for _, _, v in leaves):
        raise ValueError("leaves differ in type")
    masks = [isinstance(v, np.ma.MaskedArray) for _, _, v in leaves]
    is_masked = (masks[0] if masks else False) if is_masked is None else is_masked
    if check and any(m and not is_masked for m in masks):
        raise ValueError("a leaf has a mask that the array has not")
    first = np.concatenate([i for _, i, _ in leaves]) if leaves else np.zeros(0, np.int64)
    rest = [np.concatenate([np.full(len(i), place[d]) for place, i, _ in leaves]) if leaves else np.zeros(0, np.int64) for d in range(len(shape) - 1)]
    joined = (np.ma.concatenate if is_masked else np.concatenate)([v for _, _, v in leaves]) if leaves else np.zeros(0)
    joined = np.ma.masked_array(joined, dtype=dtype) if is_masked else np.asarray(joined, dtype)
    array = from_coordinates(spark, shape, [first, *rest], joined)
    array.node.index_dtype = np.dtype(index_dtype) if index_dtype is not None else (leaves[0][1].dtype if leaves else np.dtype("int32"))
    return array


def _bytes_below(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as Spark knows them without reading; those of unknown
    size (Spark takes them for the largest there can be) do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in found if n < 1 << 60)


def validate(array: LazyArray) -> dict[str, int]:
    """How many cells of an array have coordinates outside of its shape, or more than one
    row: one aggregation. A task's share of the cells does not grow with the array: there are
    the more tasks the larger the tables below it are."""
    df, own = array.to_df(), dims(len(array.shape))
    outside = F.lit(False)
    for d, n in zip(own, array.shape):
        outside = outside | F.col(d).isNull() | (F.col(d) < 0) | (F.col(d) >= n)
    counted = df.groupBy(*own).agg(F.count("*").alias("rows"), F.max(outside).alias("out")).agg(F.sum(F.col("out").cast("int")).alias("outside"), F.sum((F.col("rows") > 1).cast("int")).alias("repeated"))
    conf = df.sparkSession.conf
    tasks, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before, wanted = {k: conf.get(k) for k in (tasks, coalesce)}, -(-_bytes_below(df) // SHARE)
    try:
        if wanted > int(before[tasks]):
            conf.set(tasks, str(min(wanted, MOST_TASKS)))
            conf.set(coalesce, "false")  # it would join shares by their bytes on disk, which says little of cells
        found = counted.first()
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return {"outside": found["outside"] or 0, "repeated": found["repeated"] or 0}
