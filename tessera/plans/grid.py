"""Grids: how the cells of an array are best read in blocks. Planned on the driver from
shapes alone."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from tessera.plans import nodes

Job = tuple[tuple[int, int], ...]


class RegularTicks(Sequence):
    """spacing, 2 * spacing, ... up to ``final``, which is the last; nothing if final is 0."""

    def __init__(self, spacing: int, final: int):
        if spacing <= 0 or final < 0:
            raise ValueError("spacing must be positive and final must not be negative")
        self.spacing, self.final = spacing, final

    def __len__(self) -> int:
        return -(-self.final // self.spacing)

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[i] for i in range(*k.indices(len(self)))]
        i = k + len(self) if k < 0 else k
        if not 0 <= i < len(self):
            raise IndexError(k)
        return min((i + 1) * self.spacing, self.final)

    def __repr__(self) -> str:
        return f"RegularTicks({self.spacing}, {self.final})"


def _merge(ticks: Sequence[int], most: int) -> list[int]:
    """Ends of intervals: neighbours are taken together up to ``most``, larger ones cut."""
    ends, start = [], 0
    last = 0
    for tick in ticks:
        if tick - start > most:
            if last > start:
                ends.append(last)
                start = last
            while tick - start > most:
                start += most
                ends.append(start)
        last = tick
    if last > start:
        ends.append(last)
    return ends


class AbstractGrid:
    """shape, boundaries (ends of intervals in each dimension), cost; transpose, subset and
    iterate."""

    shape: tuple[int, ...]
    boundaries: tuple[Sequence[int], ...]
    cost: float

    def intervals(self, dimensions: Sequence[int] | None = None, buffer_elements: float = 1e6) -> list[list[tuple[int, int]]]:
        """Intervals of each dimension whose product gives blocks of at most
        ``buffer_elements`` cells (of one cell at least); dimensions that are not listed
        stay whole."""
        listed = range(len(self.shape)) if dimensions is None else sorted(d % len(self.shape) for d in dimensions)
        room = max(1, int(buffer_elements))
        widest = [max((b - a for a, b in zip([0, *list(t)[:-1]], t)), default=1) if k in listed else max(n, 1) for k, (t, n) in enumerate(zip(self.boundaries, self.shape))]
        while int(np.prod(widest, dtype=object)) > room and any(widest[k] > 1 for k in listed):
            k = max(listed, key=lambda k: widest[k])
            others = int(np.prod([w for i, w in enumerate(widest) if i != k], dtype=object))
            widest[k] = max(1, min(widest[k] - 1, room // others))
        chosen: list[list[tuple[int, int]]] = []
        for k, ticks in enumerate(self.boundaries):
            if k not in listed:
                chosen.append([(0, self.shape[k])] if self.shape[k] else [])
                continue
            others = int(np.prod([w for i, w in enumerate(widest) if i != k], dtype=object))
            ends = _merge(ticks, max(1, room // others))
            widest[k] = max((b - a for a, b in zip([0, *ends[:-1]], ends)), default=1)
            chosen.append(list(zip([0, *ends[:-1]], ends)))
        return chosen

    def iterate(self, dimensions: Sequence[int] | None = None, buffer_elements: float = 1e6) -> Iterator[Job]:
        """Blocks as (start, end) per dimension; the first dimension runs fastest."""
        for job in itertools.product(*self.intervals(dimensions, buffer_elements)[::-1]):
            yield job[::-1]

    def transpose(self, perm: Sequence[int]) -> AbstractGrid:
        raise NotImplementedError

    def subset(self, index: Sequence[Sequence[int] | None]) -> AbstractGrid:
        raise NotImplementedError


@dataclass(init=False)
class SimpleGrid(AbstractGrid):
    boundaries: tuple[Sequence[int], ...]
    cost_factor: float

    def __init__(self, boundaries: Sequence[Sequence[int]], cost_factor: float):
        for ticks in boundaries:
            if not isinstance(ticks, RegularTicks) and any(b <= a for a, b in zip([0, *ticks], ticks)):
                raise ValueError("boundaries must be positive and strictly increasing")
        self.boundaries, self.cost_factor = tuple(boundaries), cost_factor
        self.shape = tuple(t[-1] if len(t) else 0 for t in self.boundaries)
        self.cost = cost_factor * float(np.prod(self.shape, dtype=float))

    def transpose(self, perm: Sequence[int]) -> SimpleGrid:
        return SimpleGrid([self.boundaries[p] for p in perm], self.cost_factor)

    def subset(self, index: Sequence[Sequence[int] | None]) -> SimpleGrid:
        """An interval ends where the next position lies in another one of this grid's."""
        ticks = []
        for own, chosen in zip(self.boundaries, index):
            if chosen is None:
                ticks.append(own)
                continue
            places = np.searchsorted(np.asarray(list(own)), np.asarray(list(chosen)), side="right")
            ends = np.flatnonzero(places[1:] != places[:-1]) + 1
            ticks.append([*ends.tolist(), len(places)] if len(places) else [])
        return SimpleGrid(ticks, self.cost_factor)


class CompositeGrid(AbstractGrid):
    """Grids of arrays that stand one after the other along a dimension."""

    def __init__(self, components: Sequence[AbstractGrid], along: int):
        if not components:
            raise ValueError("a composite grid needs components")
        rest = lambda s: s[:along] + s[along + 1 :]
        if any(rest(c.shape) != rest(components[0].shape) for c in components):
            raise ValueError("extents of other dimensions differ")
        self.components, self.along = list(components), along
        self.cost = sum(c.cost for c in components)
        self.shape = tuple(sum(c.shape[along] for c in components) if k == along else n for k, n in enumerate(components[0].shape))
        dearest = max(components, key=lambda c: c.cost)
        joined, offset = [], 0
        for c in components:
            joined += [offset + t for t in c.boundaries[along]]
            offset += c.shape[along]
        self.boundaries = tuple(joined if k == along else t for k, t in enumerate(dearest.boundaries))

    def transpose(self, perm: Sequence[int]) -> CompositeGrid:
        return CompositeGrid([c.transpose(perm) for c in self.components], list(perm).index(self.along))

    def subset(self, index: Sequence[Sequence[int] | None]) -> AbstractGrid:
        """Runs of positions of one component stay a component."""
        chosen = index[self.along]
        if chosen is None:
            return CompositeGrid([c.subset(index) for c in self.components], self.along)
        limits = np.cumsum([c.shape[self.along] for c in self.components])
        chosen = np.asarray(list(chosen), np.int64)
        owners = np.searchsorted(limits, chosen, side="right")
        parts = []
        for run in np.split(np.arange(len(chosen)), np.flatnonzero(owners[1:] != owners[:-1]) + 1):
            if len(run):
                owner = self.components[owners[run[0]]]
                own = chosen[run] - (limits[owners[run[0]]] - owner.shape[self.along])
                parts.append(owner.subset([own if k == self.along else s for k, s in enumerate(index)]))
        if not parts:
            return self.components[0].subset([[] if k == self.along else s for k, s in enumerate(index)])
        return parts[0] if len(parts) == 1 else CompositeGrid(parts, self.along)

    def iterate(self, dimensions: Sequence[int] | None = None, buffer_elements: float = 1e6) -> Iterator[Job]:
        """Blocks of each component in turn, if ``along`` is among the dimensions."""
        if dimensions is not None and self.along not in [d % len(self.shape) for d in dimensions]:
            yield from super().iterate(dimensions, buffer_elements)
            return
        offset = 0
        for c in self.components:
            for job in c.iterate(dimensions, buffer_elements):
                yield tuple((a + offset, b + offset) if k == self.along else (a, b) for k, (a, b) in enumerate(job))
            offset += c.shape[self.along]


def chunk_shape_to_grid(chunks: Sequence[int], shape: Sequence[int], cost_factor: float) -> SimpleGrid:
    return SimpleGrid([RegularTicks(max(1, min(c, n)), n) if n else [] for c, n in zip(chunks, shape)], cost_factor)


def grid_of(node: nodes.Node) -> AbstractGrid:
    """The grid that suits a tree: its sources' grids, carried along."""
    if isinstance(node, nodes.Source):
        return chunk_shape_to_grid(node.chunks or node.shape, node.shape, node.cost)
    if isinstance(node, nodes.Subset):
        return grid_of(node.seed).subset([None if isinstance(s, range) and s == range(n) else s for s, n in zip(node.subset, node.seed.shape)])
    if isinstance(node, nodes.Transpose):
        return grid_of(node.seed).transpose(node.perm)
    if isinstance(node, nodes.Combine):
        return CompositeGrid([grid_of(s) for s in node.seeds], node.along)
    if isinstance(node, nodes.Binary):
        left, right = grid_of(node.left), grid_of(node.right)
        return right if right.cost > left.cost else left
    if isinstance(node, nodes.Drop | nodes.Reduce):
        return chunk_shape_to_grid(node.shape, node.shape, 1.0)
    return grid_of(node.seed)
