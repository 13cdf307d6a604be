"""tessera: lazy N-dimensional arrays as Spark relations.

What depends on a type is dispatched on it: ``wrap``, ``is_sparse``, ``is_masked``,
``chunk_grid``, ``extract_dense_array`` and ``extract_sparse_array`` take further types
by their ``register``."""

from functools import singledispatch

from numpy import ma, ndarray

from tessera.array import LazyArray, concatenate, wrap
from tessera.operators import apply_over_blocks, apply_over_dimension, blocks, contents, create_dask_array, map_blocks, to_coo, to_csc, to_csr, to_dense_array, to_sparse_array, to_sparse_matrix, write_parquet
from tessera.plans.grid import AbstractGrid, CompositeGrid, RegularTicks, SimpleGrid, chunk_shape_to_grid, grid_of
from tessera.plans.nodes import Binary, Cast, Combine, Node, Reduce, Round, Source, Subset, Transpose, Unary, WithArgs
from tessera.sources import from_array_column, from_coo, from_coordinates, from_csc, from_csr, from_numpy, from_sparse_matrix, from_table, sparse_ndarray, validate


@singledispatch
def is_sparse(x) -> bool:
    return getattr(x, "format", None) in ("csc", "csr", "coo")


@is_sparse.register
def _(x: LazyArray) -> bool:
    return x.is_sparse


@is_sparse.register
def _(x: Node) -> bool:
    return x.sparse


@singledispatch
def is_masked(x) -> bool:
    raise NotImplementedError(f"can't tell whether a {type(x).__name__} is masked")


@is_masked.register
def _(x: ndarray) -> bool:
    return isinstance(x, ma.MaskedArray)


@is_masked.register
def _(x: LazyArray) -> bool:
    return x.is_masked


@is_masked.register
def _(x: Node) -> bool:
    return x.masked


def is_pristine(x) -> bool:
    return x.is_pristine if isinstance(x, LazyArray) else not isinstance(x, Node) or isinstance(x, Source)


@singledispatch
def chunk_grid(x) -> AbstractGrid:
    raise NotImplementedError(f"no grid is known for a {type(x).__name__}")


@chunk_grid.register
def _(x: LazyArray) -> AbstractGrid:
    return grid_of(x.node)


@chunk_grid.register
def _(x: Node) -> AbstractGrid:
    return grid_of(x)


@chunk_grid.register
def _(x: ndarray) -> AbstractGrid:
    return grid_of(wrap(x).node)


@singledispatch
def extract_dense_array(x, subset=None):
    raise NotImplementedError(f"can't extract a dense array of a {type(x).__name__}")


@extract_dense_array.register
def _(x: LazyArray, subset=None):
    return to_dense_array(x if subset is None else x[tuple(subset)])


@extract_dense_array.register(Node)
@extract_dense_array.register(ndarray)
def _(x, subset=None):
    return extract_dense_array(wrap(x), subset)


@singledispatch
def extract_sparse_array(x, subset=None):
    if not is_sparse(x):
        raise NotImplementedError(f"can't extract a sparse array of a {type(x).__name__}")
    return extract_sparse_array(wrap(x), subset)


@extract_sparse_array.register
def _(x: LazyArray, subset=None):
    if not x.is_sparse:
        raise NotImplementedError("the array is not sparse")
    return to_sparse_array(x if subset is None else x[tuple(subset)])
