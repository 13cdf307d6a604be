"""Arrays as other formats, distributed or local."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.array import LazyArray
from tessera.plans.compile import dims
from tessera.plans.grid import grid_of
from tessera.plans.nodes import is_zero

PART = 1 << 20  # positions of the minor dimension that one row of a compressed format covers


def to_dense_array(x: LazyArray):
    """All cells, local."""
    return x.to_numpy()


def _explicit(x: LazyArray) -> DataFrame:
    """Cells that are not zero, or all that the relation holds of a sparse array."""
    if x.is_sparse:
        return x.to_df()
    df = x.to_df(dense=True)
    return df.where(F.col("v").isNull() | (F.col("v") if x.dtype.kind == "b" else F.col("v") != 0))


def to_sparse_array(x: LazyArray) -> tuple[list[np.ndarray], np.ndarray]:
    """(coordinates, values), local: sorted by the last dimension first, as sparse arrays
    are walked; values are a masked array if the array has a mask."""
    own = dims(x.ndim)
    table = _explicit(x).orderBy(*own[::-1]).toArrow()
    mask = table.column("v").is_null().to_numpy()
    values = np.array([0 if v is None else v for v in table.column("v").to_pylist()], x.dtype)
    return [table.column(d).to_numpy() for d in own], np.ma.masked_array(values, mask) if x.is_masked else values


def contents(x: LazyArray):
    """The nested lists that ``sparse_ndarray`` reads."""
    coordinates, values = to_sparse_array(x)
    table: dict = {}
    for k in range(len(values)):
        table.setdefault(tuple(int(c[k]) for c in coordinates[:0:-1]), []).append(k)

    def part(place: tuple[int, ...]):
        level = x.ndim - 1 - len(place)
        if level == 0:
            rows = table.get(place)
            return None if rows is None else (coordinates[0][rows].astype(x.index_dtype), values[rows])
        below = [part((*place, k)) for k in range(x.shape[level])]
        return None if all(b is None for b in below) else below

    return part(())


def to_coo(x: LazyArray) -> DataFrame:
    """(row, column, value) of each cell that is there."""
    return _explicit(x).select(F.col("d0").alias("row"), F.col("d1").alias("column"), F.col("v").alias("value"))


def _compressed(x: LazyArray, major: str, minor: str) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(F.col(minor).alias("index"), F.col("v").alias("value"))))
    part = F.expr(f"{minor} div {PART}L").alias("part")
    return _explicit(x).groupBy(F.col(major).alias("major"), part).agg(packed.alias("cells")).select("major", "part", F.col("cells.index").alias("indices"), F.col("cells.value").alias("values"))


def to_csc(x: LazyArray) -> DataFrame:
    """(major, part, indices, values): a row for each column and PART rows that have cells,
    so that no cell of the result grows with the array."""
    return _compressed(x, "d1", "d0")


def to_csr(x: LazyArray) -> DataFrame:
    """(major, part, indices, values): a row for each row and PART columns that have cells."""
    return _compressed(x, "d0", "d1")


def create_dask_array(x: LazyArray):
    """The array for dask, where that is installed: a chunk of dask's is one block of the
    array's grid, and reads nothing until dask asks for it."""
    from dask import array

    return array.from_array(x, chunks=tuple(tuple(b - a for a, b in i) for i in grid_of(x.node).intervals(None, 10**6)), asarray=True, fancy=False, meta=np.zeros((0,) * x.ndim, x.dtype))


def to_sparse_matrix(x: LazyArray, format: str = "csc") -> dict:
    """Local vectors of a matrix: data, indices and indptr (csc, csr), or data, row and col."""
    if x.ndim != 2:
        raise ValueError("only matrices have these formats")
    (rows, columns), values = to_sparse_array(x)
    if format not in ("csc", "csr"):
        return {"shape": x.shape, "data": values, "row": rows, "col": columns}
    major, minor, n = (columns, rows, x.shape[1]) if format == "csc" else (rows, columns, x.shape[0])
    order = np.lexsort((minor, major))
    return {"shape": x.shape, "data": values[order], "indices": minor[order], "indptr": np.concatenate(([0], np.cumsum(np.bincount(major, minlength=n))))}


def write_parquet(x: LazyArray, path: str, dense: bool = False, mode: str = "error") -> None:
    """The relation as Parquet, sorted in each file by the first dimension so that slices
    of it skip row groups."""
    x.to_df(dense or not is_zero(x.node.fill)).sortWithinPartitions(*dims(x.ndim)[:1]).write.mode(mode).parquet(path)
