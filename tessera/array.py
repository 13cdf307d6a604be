"""LazyArray: NumPy's notation over the operation tree."""

from __future__ import annotations

from functools import singledispatch

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.plans import nodes
from tessera.plans.compile import dims, to_df

COLLECTED = 1 << 24  # cells up to which an array comes to the driver in one job
_NAMES = {"true_divide": "divide", "absolute": "abs"}
#: Positions of arguments after the array in NumPy's functions that have a method here.
_ARGUMENTS = {
    "sum": ("axis", "dtype", "out", "keepdims", "initial", "where"),
    "mean": ("axis", "dtype", "out", "keepdims", "where"),
    "var": ("axis", "dtype", "out", "ddof", "keepdims", "where", "mean", "correction"),
    "any": ("axis", "out", "keepdims", "where"),
    "all": ("axis", "out", "keepdims", "where"),
    "round": ("decimals", "out"),
    "transpose": ("axes",),
    "concatenate": ("axis", "out", "dtype", "casting"),
}
_TAKEN = ("axis", "dtype", "ddof", "decimals", "axes")


def _arguments(name: str, given: tuple, named: dict) -> dict:
    """Arguments of a NumPy function by name. Those that have no counterpart here must have
    the value that changes nothing."""
    found = dict(zip(_ARGUMENTS[name], given, strict=False)) | named
    taken = {k: v for k, v in found.items() if k in _TAKEN and not (name == "concatenate" and k == "dtype")}
    for k, v in found.items():
        if k not in taken and not (v is None or v is np._NoValue or (k == "keepdims" and v is False) or (k == "where" and v is True)):
            raise TypeError(f"numpy.{name} of a lazy array does not take '{k}'")
    return taken


def _node(value) -> nodes.Node:
    return value.node if isinstance(value, LazyArray) else value


def operate(x: LazyArray, other, operation: str, right: bool = True) -> LazyArray:
    """``x operation other``, or the other way about if not ``right``. An operand of x's
    shape is joined cell by cell; a scalar, a vector along the last dimension, or an
    array with one extent other than 1 applies along that dimension."""
    shape = x.shape
    if isinstance(other, LazyArray) and other.shape == shape:
        pair = (x.node, other.node) if right else (other.node, x.node)
        return LazyArray(nodes.Binary(*pair, operation))
    if other is np.ma.masked:
        return LazyArray(nodes.WithArgs(x.node, other, operation, right, None))
    if not isinstance(other, LazyArray):
        other = other if isinstance(other, bool | int | float) else np.asanyarray(other)
        if np.ndim(other) and np.shape(other) == shape:
            return operate(x, x.like(other), operation, right)
    extents = np.shape(other) if not isinstance(other, LazyArray) else other.shape
    if len(extents) <= 1:
        along = len(shape) - 1 if extents else None
    else:
        wide = [k for k, n in enumerate(extents) if n != 1]
        if len(extents) != len(shape) or len(wide) > 1:
            raise ValueError(f"an operand of shape {extents} does not go with one of {shape}")
        along = wide[0] if wide else None
    if isinstance(other, LazyArray):
        if along is None:
            other, along = np.asanyarray(other.to_numpy()).reshape(-1)[0], None
        else:
            value = other.node if len(extents) == 1 else nodes.Drop(other.node, tuple(k for k in range(len(extents)) if k != along))
            return LazyArray(nodes.WithArgs(x.node, value, operation, right, along))
    elif along is None and np.ndim(other):
        other = other.reshape(-1)[0]
    elif along is not None:
        other = other.reshape(-1)
    return LazyArray(nodes.WithArgs(x.node, other, operation, right, along))


def _position(index, n: int):
    """One dimension's index as a range or vector of positions, and whether it is a number."""
    if isinstance(index, int | np.integer) and not isinstance(index, bool | np.bool_):
        k = int(index) + n if index < 0 else int(index)
        if not 0 <= k < n:
            raise IndexError(f"{index} is outside of an extent of {n}")
        return range(k, k + 1), True
    if isinstance(index, slice):
        return range(n)[index], False
    if isinstance(index, range):
        index = np.arange(index.start, index.stop, index.step)
    index = np.asarray(index)
    if index.ndim != 1:
        raise NotImplementedError("an index must have one dimension")
    if index.dtype.kind == "b" and len(index) != n:
        raise IndexError(f"{len(index)} truth values for an extent of {n}")
    return np.arange(n)[index if len(index) else np.zeros(0, np.int64)], False


def _packed(shape: tuple[int, ...], dtype: np.dtype):
    """Cells as rows of flat positions, values and whether they are masked, as bytes."""
    names = dims(len(shape))
    steps = [int(np.prod(shape[k + 1 :], dtype=object)) for k in range(len(shape))]

    def run(batches):
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int64)
            for name, step in zip(names, steps):
                at += batch.column(name).to_numpy() * step
            values = batch.column("v")
            absent = values.is_null().to_numpy(zero_copy_only=False)
            if dtype == np.dtype("uint64"):  # decimals
                data = np.array([int(x or 0) for x in values.to_pylist()], np.uint64)
            else:
                data = values.fill_null(False if dtype.kind == "b" else 0).to_numpy(zero_copy_only=False).astype(dtype)
            yield pa.record_batch({"at": pa.array([at.tobytes()], pa.binary()), "v": pa.array([data.tobytes()], pa.binary()), "absent": pa.array([absent.tobytes()], pa.binary())})

    return run


class LazyArray:
    """An array of which only the operation tree exists until its cells are asked for.

    ``to_df()`` gives the relation d0..dn-1, v; ``to_numpy()`` collects it."""

    def __init__(self, node: nodes.Node):
        self.node = node

    def copy(self) -> LazyArray:
        """Another array over the same tree: nodes never change."""
        return type(self)(self.node)

    @property
    def index_dtype(self) -> np.dtype:
        """The type of coordinates of the (first) source, through all operations."""
        node = self.node
        while below := nodes.children(node):
            node = below[0]
        return np.dtype(getattr(node, "index_dtype", None) or "int64")

    # --- what is known without data

    @property
    def shape(self) -> tuple[int, ...]:
        return self.node.shape

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.node.dtype)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=object))

    @property
    def seed(self):
        """The tree's top, or what the array was made from where no operation is stacked."""
        return self.node.pristine if isinstance(self.node, nodes.Source) else self.node

    @property
    def is_sparse(self) -> bool:
        return bool(self.node.sparse)

    @property
    def is_masked(self) -> bool:
        return bool(self.node.masked)

    @property
    def is_pristine(self) -> bool:
        return isinstance(self.node, nodes.Source)

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("an array without dimensions has no length")
        return self.shape[0]

    def __repr__(self) -> str:
        extents = " x ".join(map(str, self.shape))
        return f"<{extents}>{' sparse' if self.is_sparse else ''}{' masked' if self.is_masked else ''} {type(self).__name__} object of type '{self.dtype.name}'"

    def preview(self, edge: int = 3) -> str:
        """The header and the cells at the edges, the only ones that are read."""
        ends = tuple(sorted({*range(min(edge, n)), *range(max(0, n - edge), n)}) for n in self.shape)
        corner = LazyArray(nodes.subset(self.node, [np.array(e, np.int64) for e in ends]))
        return f"{self!r}\n{corner.to_numpy()!r}"

    def __str__(self) -> str:
        return self.preview()

    def like(self, values) -> LazyArray:
        from tessera.sources import from_numpy
        from tessera.plans.compile import _session

        return from_numpy(_session(), values)

    # --- results

    def to_df(self, dense: bool = False, stored: bool = False) -> DataFrame:
        """The relation; with ``dense`` one row for every cell; with ``stored`` rows of an elementwise
        expression only where the sparse array below it has them: NumPy's 0 / 0 in columns without
        cells stays out."""
        return to_df(nodes.at_stored_cells(self.node) if stored and not dense else self.node, dense)

    def to_numpy(self, dtype=None):
        """All cells, on the driver, in the array's type or another one; a masked array if
        the array has a mask. Cells come packed and go straight to their places; of arrays
        of over COLLECTED cells a partition at a time."""
        fill, shape, own = self.node.fill if self.node.implicit else 0, self.shape, self.dtype
        with np.errstate(all="ignore"):
            out = np.full(shape, np.zeros(1, own)[0] if fill is None else np.asarray(fill, own)[()], own).astype(dtype or own)
        mask = np.full(shape, self.node.implicit and fill is None)
        flat, hidden = out.reshape(-1), mask.reshape(-1)
        packed = self.to_df().mapInArrow(_packed(shape, own), "at binary, v binary, absent binary")
        for row in packed.collect() if self.size <= COLLECTED else packed.toLocalIterator():
            at, absent = np.frombuffer(row["at"], np.int64), np.frombuffer(row["absent"], bool)
            with np.errstate(all="ignore"):
                flat[at] = np.frombuffer(row["v"], own)
            hidden[at] = absent
        return np.ma.masked_array(out, mask) if self.is_masked else out

    def item(self):
        out = self.to_numpy()
        return np.ma.masked if self.is_masked and np.ma.getmaskarray(out).reshape(-1)[0] else np.ma.getdata(out).reshape(-1)[0]

    def __array__(self, dtype=None, copy=None):
        return self.to_numpy(dtype)

    def __float__(self) -> float:
        return float(self.item())

    def __int__(self) -> int:
        return int(self.item())

    def __bool__(self) -> bool:
        if self.size != 1:
            raise ValueError("the truth value of an array is ambiguous")
        return bool(self.item())

    __hash__ = object.__hash__

    # --- shape

    @property
    def T(self) -> LazyArray:
        return self.transpose()

    def transpose(self, axes=None) -> LazyArray:
        return LazyArray(nodes.transpose(self.node, axes))

    def __getitem__(self, index) -> LazyArray:
        index = index if isinstance(index, tuple) else (index,)
        if sum(i is Ellipsis for i in index) == 1:
            at = next(k for k, i in enumerate(index) if i is Ellipsis)
            index = index[:at] + (slice(None),) * (self.ndim - len(index) + 1) + index[at + 1 :]
        if len(index) > self.ndim:
            raise ValueError(f"{len(index)} indices for {self.ndim} dimensions")
        index = index + (slice(None),) * (self.ndim - len(index))
        if self.ndim > 1 and all(isinstance(i, np.ndarray) and i.ndim == self.ndim and i.size == i.shape[k] for k, i in enumerate(index)):
            index = tuple(i.reshape(-1) for i in index)  # an open mesh
        if any(isinstance(i, LazyArray) for i in index):
            raise NotImplementedError("an index can't be lazy")
        chosen = [_position(i, n) for i, n in zip(index, self.shape)]
        made = nodes.subset(self.node, [c for c, _ in chosen])
        gone = tuple(k for k, (_, number) in enumerate(chosen) if number)
        return LazyArray(nodes.Drop(made, gone) if gone else made)

    # --- elementwise

    def astype(self, dtype, **_) -> LazyArray:
        return LazyArray(nodes.Cast(self.node, np.dtype(dtype)))

    def round(self, decimals: int = 0) -> LazyArray:
        return LazyArray(nodes.Round(self.node, decimals))

    def __neg__(self) -> LazyArray:
        return operate(self, np.zeros(1, self.dtype)[0], "subtract", False)

    def __abs__(self) -> LazyArray:
        return LazyArray(nodes.Unary(self.node, "abs"))

    def __array_ufunc__(self, ufunc, method, *inputs, **given):
        name = _NAMES.get(ufunc.__name__, ufunc.__name__)
        if method != "__call__":
            raise NotImplementedError(f"'{ufunc.__name__}.{method}' is not supported")
        if given := [k for k, v in given.items() if v is not None and not (k == "where" and v is True)]:
            raise TypeError(f"numpy.{ufunc.__name__} of a lazy array does not take '{given[0]}'")
        if name == "fabs":  # of floats only, as NumPy has it
            real = np.fabs(np.zeros(1, self.dtype)).dtype
            return abs(self if real == self.dtype else self.astype(real))
        if len(inputs) == 1:
            return LazyArray(nodes.Unary(self.node, name))
        if isinstance(inputs[0], LazyArray) and (not isinstance(inputs[1], LazyArray) or len(inputs[0].shape) >= len(inputs[1].shape)):
            return operate(inputs[0], inputs[1], name)
        return operate(inputs[1], inputs[0], name, False)

    def __array_function__(self, function, types, args, kwargs):
        name = {"around": "round"}.get(function.__name__, function.__name__)
        if name == "shape":
            return self.shape
        if name not in _ARGUMENTS:
            raise NotImplementedError(f"'{name}' is not supported")
        taken = _arguments(name, args[1:], kwargs)
        if name == "concatenate":
            return concatenate(args[0], **taken)
        return getattr(args[0], name)(**taken)

    # --- reductions

    def _reduce(self, operation: str, axis, dtype=None, ddof: int = 0) -> LazyArray:
        axes = range(self.ndim) if axis is None else [axis] if isinstance(axis, int | np.integer) else axis
        if any(not -self.ndim <= a < self.ndim for a in axes):
            raise ValueError(f"axis {axis} is outside of {self.ndim} dimensions")
        return LazyArray(nodes.Reduce(self.node, operation, tuple(sorted({int(a) % self.ndim for a in axes})), dtype, ddof))

    def sum(self, axis=None, dtype=None, buffer_size=None) -> LazyArray:
        return self._reduce("sum", axis, dtype)

    def mean(self, axis=None, dtype=None, buffer_size=None) -> LazyArray:
        return self._reduce("mean", axis, dtype)

    def var(self, axis=None, dtype=None, ddof: int = 0, buffer_size=None) -> LazyArray:
        return self._reduce("var", axis, dtype, ddof)

    def any(self, axis=None, dtype=None, buffer_size=None) -> LazyArray:
        found = self._reduce("any", axis)
        return found if dtype is None else found.astype(dtype)

    def all(self, axis=None, dtype=None, buffer_size=None) -> LazyArray:
        found = self._reduce("all", axis)
        return found if dtype is None else found.astype(dtype)


def _method(operation: str, right: bool):
    return lambda self, other: operate(self, other, operation, right)


for _name, _operation in {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "mod": "remainder", "floordiv": "floor_divide", "pow": "power", "and": "logical_and", "or": "logical_or"}.items():
    setattr(LazyArray, f"__{_name}__", _method(_operation, True))
    setattr(LazyArray, f"__r{_name}__", _method(_operation, False))
for _name, _operation in {"eq": "equal", "ne": "not_equal", "ge": "greater_equal", "gt": "greater", "le": "less_equal", "lt": "less"}.items():
    setattr(LazyArray, f"__{_name}__", _method(_operation, True))


@singledispatch
def wrap(x) -> LazyArray:
    """A LazyArray of a LazyArray (itself), a node, local data, or a sparse matrix object
    (what has ``format`` csc, csr or coo and that format's vectors). Other types are
    registered: ``@wrap.register`` a function that makes a LazyArray of them."""
    from tessera.plans.compile import _session
    from tessera.sources import from_numpy, from_sparse_matrix

    if getattr(x, "format", None) in ("csc", "csr", "coo") and hasattr(x, "shape"):
        return from_sparse_matrix(_session(), x)
    return from_numpy(_session(), x)


@wrap.register
def _(x: LazyArray) -> LazyArray:
    return x


@wrap.register
def _(x: nodes.Node) -> LazyArray:
    return LazyArray(x)


def concatenate(arrays, axis: int = 0) -> LazyArray:
    return LazyArray(nodes.combine([_node(wrap(a)) for a in arrays], axis))
