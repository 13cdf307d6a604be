"""User functions over blocks. Blocks are planned on the driver; their cells meet in the
tasks, where the functions run."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.array import LazyArray
from tessera.plans import nodes
from tessera.plans.compile import _session, dims
from tessera.plans.grid import AbstractGrid, Job, grid_of


def _planned(x: LazyArray, grid: AbstractGrid | None, dimensions: Sequence[int] | None, buffer_size: float) -> list[list[tuple[int, int]]]:
    return (grid or grid_of(x.node)).intervals(dimensions, max(1, int(buffer_size) // max(1, x.dtype.itemsize)))


def _number(column: Column, intervals: list[tuple[int, int]]) -> Column:
    """The interval that holds a coordinate: by division where all but the last are as long,
    else by search."""
    width = intervals[0][1] - intervals[0][0]
    if all(b - a == width for a, b in intervals[:-1]) and intervals[-1][1] - intervals[-1][0] <= width:
        return F.floor(column / width).cast("long")
    ends = np.array([b for _, b in intervals])

    @F.pandas_udf("long")
    def search(d: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, d.to_numpy(), side="right"))

    return search(column)


def _filled(x: LazyArray, job: Job, cells: pd.DataFrame, sparse: bool):
    """A block as an array, or as (coordinates, values) of the cells that are there."""
    own = [cells[d].to_numpy(np.int64) - a for d, (a, _) in zip(dims(len(job)), job)]
    absent = cells["v"].isna().to_numpy() if x[1] else np.zeros(len(cells), bool)
    data = np.array([0 if m else v for v, m in zip(cells["v"], absent)], x[0]) if len(cells) else np.zeros(0, x[0])
    if sparse:
        return own, np.ma.masked_array(data, absent) if x[1] else data
    shape = tuple(b - a for a, b in job)
    out, mask = np.empty(shape, x[0]), np.full(shape, x[2] and x[3] is None)
    out[...] = 0 if x[3] is None else x[3]
    out[tuple(own)], mask[tuple(own)] = data, absent
    return np.ma.masked_array(out, mask) if x[1] else out


def map_blocks(x: LazyArray, function: Callable, schema: str, dimensions: Sequence[int] | None = None, allow_sparse: bool = False, grid: AbstractGrid | None = None, buffer_size: float = 1e8) -> DataFrame:
    """The rows that ``function(job, block)`` returns (a pandas DataFrame of ``schema``) for
    each block, distributed. ``job`` is (start, end) for each dimension; a block without
    cells is one, too. With ``allow_sparse``, blocks of sparse arrays are (coordinates,
    values)."""
    intervals = _planned(x, grid, dimensions, buffer_size)
    counts = [len(i) for i in intervals]
    total = int(np.prod(counts, dtype=object))
    known = (x.dtype, x.is_masked, x.node.implicit, x.node.fill if x.node.implicit else 0)
    sparse, steps = allow_sparse and x.is_sparse, np.cumprod([1, *counts[:-1]]).tolist()
    numbered = x.to_df()
    block = F.lit(0).cast("long")
    for k, step in enumerate(steps):
        if total:
            block = block + _number(F.col(f"d{k}"), intervals[k]) * step
    numbered = numbered.withColumn("_block", block)

    def job_of(block: int) -> Job:
        return tuple(i[block // s % c] for i, s, c in zip(intervals, steps, counts))

    def run(wanted: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        job = job_of(int(wanted["_block"].iloc[0])) if len(wanted) else job_of(int(cells["_block"].iloc[0]))
        return function(job, _filled(known, job, cells, sparse))

    every = _session().range(total).select(F.col("id").alias("_block"))
    return every.groupBy("_block").cogroup(numbered.groupBy("_block")).applyInPandas(run, schema)


def _results(x, function, dimensions, allow_sparse, grid, buffer_size, narrow):
    intervals = _planned(x, grid, dimensions, buffer_size)
    counts = [len(i) for i in intervals]

    def one(job: Job, block) -> pd.DataFrame:
        number, step = 0, 1
        for k, i in enumerate(intervals):
            number, step = number + i.index(job[k]) * step, step * counts[k]
        return pd.DataFrame({"block": [number], "result": [pickle.dumps(function(narrow(job), block))]})

    rows = map_blocks(x, one, "block long, result binary", dimensions, allow_sparse, grid, buffer_size).collect()
    return [pickle.loads(r["result"]) for r in sorted(rows, key=lambda r: r["block"])]


def apply_over_blocks(x: LazyArray, function: Callable, allow_sparse: bool = False, grid: AbstractGrid | None = None, buffer_size: float = 1e8) -> list:
    """Results of ``function(job, block)`` for all blocks, in order; functions run in tasks,
    so effects on the driver are lost (see ``blocks``)."""
    return _results(x, function, None, allow_sparse, grid, buffer_size, lambda job: job)


def apply_over_dimension(x: LazyArray, dimension: int, function: Callable, allow_sparse: bool = False, grid: AbstractGrid | None = None, buffer_size: float = 1e8) -> list:
    """Results of ``function((start, end), block)``, blocks spanning all other dimensions."""
    dimension %= x.ndim
    return _results(x, function, [dimension], allow_sparse, grid, buffer_size, lambda job: job[dimension])


def blocks(x: LazyArray, dimensions: Sequence[int] | None = None, grid: AbstractGrid | None = None, buffer_size: float = 1e8) -> Iterator[tuple[Job, np.ndarray]]:
    """(job, block) one after the other on the driver, which holds one block at a time."""
    chosen = grid or grid_of(x.node)
    for job in chosen.iterate(dimensions, max(1, int(buffer_size) // max(1, x.dtype.itemsize))):
        yield job, LazyArray(nodes.subset(x.node, [range(a, b) for a, b in job])).to_numpy()
