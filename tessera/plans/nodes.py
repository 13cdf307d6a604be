"""Nodes of the operation tree. A node knows shape, element type, what its absent
cells hold and whether it has a mask, all without touching data.

``fill``: an array may leave cells out of its relation; they hold ``fill`` (None:
masked). ``implicit`` says whether it does. A sparse array is one whose absent cells
are zero. Elementwise operations change the fill along with the cells, so nothing is
ever filled in until somebody asks for all cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from tessera.functions import numerics

Index = range | np.ndarray


def _apply(function: Callable, *values):
    """A scalar result of NumPy, None standing for masked cells."""
    if any(v is None for v in values):
        return None
    with np.errstate(all="ignore"):
        out = function(*(np.ma.masked_array([v], mask=[False]) if masked else np.array([v]) for v, masked in values))
    return None if np.ma.getmaskarray(out)[0] else out[0]


def is_zero(value) -> bool:
    return value is not None and value == 0


class Node:
    """Base of all nodes; ``seed`` is the node below, where there is one."""

    shape: tuple[int, ...]
    dtype: np.dtype
    masked: bool
    implicit: bool
    fill: object

    @property
    def sparse(self) -> bool:
        return self.implicit and is_zero(self.fill)


@dataclass(eq=False)
class Source(Node):
    """Cells that are there: ``cells(subset)`` gives a relation d0..dn-1, v; it may use
    the subset (per dimension a range or None) to read less, and need not."""

    cells: Callable
    shape: tuple[int, ...]
    dtype: np.dtype
    implicit: bool = False
    masked: bool = False
    chunks: tuple[int, ...] | None = None  # extents that are read together
    cost: float = 1.0
    pristine: object = None  # what the user handed in
    index_dtype: object = None  # of coordinates, where the user's data had one

    @property
    def fill(self):
        return np.zeros(1, self.dtype)[0]


@dataclass(eq=False)
class Subset(Node):
    """Per dimension the old positions, in the new order; duplicates are allowed."""

    seed: Node
    subset: tuple[Index, ...]

    def __post_init__(self):
        if len(self.subset) != len(self.seed.shape):
            raise ValueError(f"{len(self.subset)} subsets for an array of {len(self.seed.shape)} dimensions")
        self.shape = tuple(len(s) for s in self.subset)
        self.dtype, self.masked, self.implicit, self.fill = self.seed.dtype, self.seed.masked, self.seed.implicit, self.seed.fill


@dataclass(eq=False)
class Drop(Node):
    """Without dimensions of extent one."""

    seed: Node
    dimensions: tuple[int, ...]

    def __post_init__(self):
        self.shape = tuple(n for k, n in enumerate(self.seed.shape) if k not in self.dimensions)
        self.dtype, self.masked, self.implicit, self.fill = self.seed.dtype, self.seed.masked, self.seed.implicit, self.seed.fill


@dataclass(eq=False)
class Transpose(Node):
    seed: Node
    perm: tuple[int, ...]

    def __post_init__(self):
        n = len(self.seed.shape)
        if sorted(self.perm) != list(range(n)):
            raise ValueError(f"{self.perm} does not permute {n} dimensions")
        self.shape = tuple(self.seed.shape[p] for p in self.perm)
        self.dtype, self.masked, self.implicit, self.fill = self.seed.dtype, self.seed.masked, self.seed.implicit, self.seed.fill


@dataclass(eq=False)
class Combine(Node):
    """Arrays one after the other along a dimension. Unless all leave out cells of the
    same fill, those that do are filled in."""

    seeds: tuple[Node, ...]
    along: int

    def __post_init__(self):
        if not self.seeds:
            raise ValueError("nothing to combine")
        first, along = self.seeds[0], self.along
        if not 0 <= along < len(first.shape):
            raise ValueError(f"there is no dimension {along}")
        rest = lambda s: s[:along] + s[along + 1 :]
        if any(len(s.shape) != len(first.shape) or rest(s.shape) != rest(first.shape) for s in self.seeds):
            raise ValueError("extents of other dimensions differ")
        self.shape = first.shape[:along] + (sum(s.shape[along] for s in self.seeds),) + first.shape[along + 1 :]
        self.dtype = np.concatenate([np.zeros(1, s.dtype) for s in self.seeds]).dtype
        self.masked = any(s.masked for s in self.seeds)
        self.implicit = all(s.implicit for s in self.seeds) and all(s.fill is first.fill or (s.fill is not None and first.fill is not None and s.fill == first.fill) for s in self.seeds)
        self.fill = first.fill


@dataclass(eq=False)
class Cast(Node):
    seed: Node
    dtype: np.dtype

    def __post_init__(self):
        self.dtype = np.dtype(self.dtype)
        self.shape, self.masked, self.implicit = self.seed.shape, self.seed.masked, self.seed.implicit
        with np.errstate(all="ignore"):
            self.fill = None if self.seed.fill is None else np.array([self.seed.fill]).astype(self.dtype)[0]


@dataclass(eq=False)
class Round(Node):
    seed: Node
    decimals: int = 0

    def __post_init__(self):
        self.shape, self.dtype, self.masked, self.implicit = self.seed.shape, self.seed.dtype, self.seed.masked, self.seed.implicit
        self.fill = None if self.seed.fill is None or self.dtype.kind == "b" else np.round(self.seed.fill, self.decimals)


@dataclass(eq=False)
class Unary(Node):
    seed: Node
    operation: str

    def __post_init__(self):
        if self.operation not in numerics.UNARY:
            raise NotImplementedError(f"'{self.operation}' is not supported")
        function = numerics.numpy_function(self.operation)
        self.shape, self.masked, self.implicit = self.seed.shape, self.seed.masked, self.seed.implicit
        with np.errstate(all="ignore"):
            self.dtype = function(np.zeros(1, self.seed.dtype)).dtype
        self.fill = None if self.seed.fill is None else _apply(function, (self.seed.fill, self.masked))


@dataclass(eq=False)
class WithArgs(Node):
    """``seed operation value``, or the other way about if not ``right``. ``value`` is a
    scalar (``along`` None; numpy.ma.masked for a masked one), a vector of NumPy along a
    dimension, or a node of one dimension, which stays distributed."""

    seed: Node
    value: object
    operation: str
    right: bool = True
    along: int | None = None
    stored: bool = False  # without the slices that the vector would fill in

    def __post_init__(self):
        if self.operation not in numerics.BINARY:
            raise NotImplementedError(f"'{self.operation}' is not supported")
        function = numerics.numpy_function(self.operation)
        self.shape = self.seed.shape
        if self.along is not None:
            n = self.value.shape[0]
            if n != self.shape[self.along]:
                raise ValueError(f"{n} values for an extent of {self.shape[self.along]}")
        if isinstance(self.value, Node):
            other, value_masked = np.zeros(1, self.value.dtype), self.value.masked
        elif self.value is np.ma.masked:
            other, value_masked = np.zeros(1, self.seed.dtype), True
        else:
            other, value_masked = self.value, isinstance(self.value, np.ma.MaskedArray)
            if self.along is not None:
                other = np.ones(1, self.value.dtype)
        self.value_dtype = np.asarray(other).dtype
        one = np.zeros(1, self.seed.dtype)
        with np.errstate(all="ignore"):
            if self.operation == "power" and self.along is None and not self.right:
                one = np.ones(1, self.seed.dtype)
            self.dtype = np.ma.getdata(function(one, other) if self.right else function(other, one)).dtype
        self.masked = self.seed.masked or value_masked
        self.implicit, self.fill = self.seed.implicit, None
        if self.implicit:
            fills = self.fills()
            # absent cells that differ along the vector can't be left out
            if fills is None:
                self.implicit = False
            else:
                self.fill = fills

    def fills(self):
        if self.along is None:
            return None if self.value is np.ma.masked else self._fill_of(self.value)
        if isinstance(self.value, Node):
            # zero stays zero but for some values of the vector, whose slices are filled in
            keeps = self.operation in ("multiply", "logical_and") or (self.right and self.operation in ("divide", "floor_divide", "remainder"))
            return np.zeros(1, self.dtype)[0] if keeps and is_zero(self.seed.fill) else None
        fill, dtype = self.seed.fill, self.dtype
        if fill is None:
            return None
        with np.errstate(all="ignore"):
            data = np.ma.getdata(self.value)
            left = np.full(len(data), fill)
            if isinstance(self.value, np.ma.MaskedArray) or self.seed.masked:
                left, data = np.ma.masked_array(left), np.ma.masked_array(self.value)
            f = numerics.numpy_function(self.operation)
            out = f(left, data) if self.right else f(data, left)
        if np.ma.getmaskarray(out).any() or not len(out):
            return np.zeros(1, dtype)[0] if not len(out) else None
        out = np.ma.getdata(out)
        return out[0] if (out == out[0]).all() else None

    def _fill_of(self, value):
        f = numerics.numpy_function(self.operation)
        fill = (self.seed.fill, self.masked)
        if self.seed.fill is None or value is None:
            return None
        other = (np.asarray(value)[()], self.masked)
        return _apply(lambda x, y: f(x, y).astype(self.dtype), fill, other) if self.right else _apply(lambda x, y: f(x, y).astype(self.dtype), other, fill)


@dataclass(eq=False)
class Binary(Node):
    left: Node
    right: Node
    operation: str

    def __post_init__(self):
        if self.left.shape != self.right.shape:
            raise ValueError(f"shapes {self.left.shape} and {self.right.shape} differ")
        if self.operation not in numerics.BINARY:
            raise NotImplementedError(f"'{self.operation}' is not supported")
        function = numerics.numpy_function(self.operation)
        self.shape = self.left.shape
        with np.errstate(all="ignore"):
            self.dtype = function(np.zeros(1, self.left.dtype), np.zeros(1, self.right.dtype)).dtype
        self.masked = self.left.masked or self.right.masked
        self.implicit = self.left.implicit and self.right.implicit
        self.fill = None
        if self.implicit and self.left.fill is not None and self.right.fill is not None:
            self.fill = _apply(function, (self.left.fill, self.masked), (self.right.fill, self.masked))


@dataclass(eq=False)
class Reduce(Node):
    """sum, mean, var, any or all over ``axes``. Groups without a cell are implicit."""

    seed: Node
    operation: str
    axes: tuple[int, ...]
    dtype: np.dtype | None = None
    ddof: int = 0

    def __post_init__(self):
        shape = self.seed.shape
        self.shape = tuple(n for k, n in enumerate(shape) if k not in self.axes)
        self.n = int(np.prod([shape[k] for k in self.axes], dtype=object)) if self.axes else 1
        self.masked, self.implicit = self.seed.masked, True
        ones = np.ones(2, self.seed.dtype)
        default = {"sum": np.sum, "mean": np.mean, "var": np.var}[self.operation](ones).dtype if self.operation in ("sum", "mean", "var") else np.dtype(bool)
        self.dtype = np.dtype(self.dtype) if self.dtype is not None and self.operation in ("sum", "mean", "var") else default

    @cached_property
    def fill(self):
        """What a group holds whose cells are all absent."""
        n, fill = (self.n, self.seed.fill) if self.seed.implicit else (0, 0)
        if fill is None:
            n = 0
        if self.masked and (n == 0 if self.operation != "var" else n - self.ddof <= 0):
            return None
        kind = self.dtype.type
        with np.errstate(all="ignore"):
            if self.operation == "sum":
                return kind(fill * n) if n else kind(0)
            if self.operation == "mean":
                return kind(fill) if n else kind(np.nan)
            if self.operation == "var":
                return kind(fill - fill) if n - self.ddof > 0 else kind(np.nan)
        return np.bool_(bool(n) and bool(fill)) if self.operation == "any" else np.bool_(not n or bool(fill))


# --- rewrites -----------------------------------------------------------------------


def subset(seed: Node, index: Sequence[Index]) -> Node:
    """A Subset; subsets of a subset are one, and one that changes nothing is none."""
    index = tuple(index)
    if isinstance(seed, Subset):
        index = tuple(old[new.start : None if new.stop < 0 else new.stop : new.step] if isinstance(old, range) and isinstance(new, range) else np.asarray(old)[np.asarray(new, np.int64)] for old, new in zip(seed.subset, index))
        seed = seed.seed
        if all(isinstance(s, range) and s == range(n) for s, n in zip(index, seed.shape)):
            return seed
    return Subset(seed, index)


def transpose(seed: Node, perm: Sequence[int] | None = None) -> Node:
    """A Transpose; two in a row are one, and the identity after another is none."""
    perm = tuple(range(len(seed.shape)))[::-1] if perm is None else tuple(p % len(seed.shape) for p in perm)
    if isinstance(seed, Transpose):
        checked = Transpose(seed, perm)
        perm, seed = tuple(seed.perm[p] for p in checked.perm), seed.seed
        if perm == tuple(range(len(perm))):
            return seed
    return Transpose(seed, perm)


def combine(seeds: Sequence[Node], along: int = 0) -> Node:
    """A Combine; combinations along the same dimension are flattened, and one of a single
    array is that array."""
    along = along % len(seeds[0].shape) if seeds and seeds[0].shape else along
    flat: list[Node] = []
    for s in seeds:
        flat += s.seeds if isinstance(s, Combine) and s.along == along else [s]
    return flat[0] if len(flat) == 1 else Combine(tuple(flat), along)


def at_stored_cells(node: Node) -> Node:
    """The same elementwise expression at places only that the array below it holds: without slices
    that a vector fills in, as NumPy's 0 / 0 does in a column whose cells are all absent."""
    if not isinstance(node, Cast | Round | Unary | WithArgs):
        return node
    made = copy(node)
    made.seed = at_stored_cells(node.seed)
    if isinstance(made, WithArgs):
        made.stored = True
    return made


def children(node: Node) -> tuple[Node, ...]:
    if isinstance(node, Combine):
        return node.seeds
    if isinstance(node, Binary):
        return node.left, node.right
    below = (node.seed,) if hasattr(node, "seed") else ()
    return below + ((node.value,) if isinstance(node, WithArgs) and isinstance(node.value, Node) else ())
