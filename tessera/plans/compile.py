"""From the operation tree to DataFrames.

A relation has a column d0..dn-1 for each dimension and v for the value. Elementwise
nodes become projections of v, which Catalyst fuses; transposes rename columns; slices
are filters and index arithmetic, which reach the scan; gathers join an index map;
reductions are one aggregation on the dimensions kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.dtypes import literal, spark_type, to_type
from tessera.functions import numerics
from tessera.plans.nodes import Binary, Cast, Combine, Drop, Node, Reduce, Round, Source, Subset, Transpose, Unary, WithArgs

BROADCAST_ROWS = 200_000  # index maps and vectors up to this length go to all tasks; longer ones are joined by shuffle
RUN = 1 << 18  # successive cells that are written out together
LEAST, MOST = 1 << 20, 1 << 24  # cells that a task writes out: shares are not made smaller, nor (on average) larger
INLINE = 64  # vectors up to this length become part of the expression


def dims(n: int) -> list[str]:
    return [f"d{k}" for k in range(n)]


def _session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of known ``rows``, broadcast if they are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def cells_of(shape: tuple[int, ...]) -> int:
    """The number of cells of an array that is to be written out."""
    total = int(np.prod(shape, dtype=object)) if shape else 1
    if total >= 1 << 63:
        raise ValueError(f"{shape} has too many cells to write out")
    return total


def grid(shape: tuple[int, ...]) -> DataFrame:
    """All coordinates of ``shape``, made on the executors."""
    total = cells_of(shape)
    columns, step = [], 1
    for k, n in enumerate(shape):
        columns.append(F.expr(f"(id div {step}L) % {max(n, 1)}L").alias(f"d{k}"))
        step *= max(n, 1)
    return _session().range(total).select(*columns, *([] if shape else [F.lit(1).alias("_")]))


def densify(df: DataFrame, node: Node) -> DataFrame:
    """``df`` with its absent cells written out; a masked cell that is there stays masked. Only cells
    that are there are moved, to the run of successive cells that they lie in; each gives the rows up
    to the next one, so absent cells are in no shuffle."""
    own = dims(len(node.shape))
    filled = literal(node.fill, node.dtype)
    if not own:
        return _session().range(1).select(F.lit(1).alias("_")).join(df.withColumn("_there", F.lit(1)), how="left").select(F.when(F.col("_there").isNull(), filled).otherwise(F.col("v")).alias("v"))
    total = cells_of(node.shape)
    run = max(1, min(RUN, total))
    tasks = max(1, min(-(-total // LEAST), max(int(_session().conf.get("spark.sql.shuffle.partitions")), -(-total // MOST))))
    number, inside = F.lit(0).cast("long"), F.lit(True)
    for d, n in zip(own, node.shape):
        number = number * F.lit(n).cast("long") + F.col(d)
        inside = inside & (F.col(d) >= 0) & (F.col(d) < n)
    there = df.where(inside).select(number.alias("_n"), "v").select(F.expr(f"_n div {run}L").alias("_run"), F.expr(f"_n % {run}L").cast("int").alias("_at"), "v")
    starts = _session().range(-(-total // run)).select(F.col("id").alias("_run"), F.lit(-1).alias("_at"), F.lit(None).cast(df.schema["v"].dataType).alias("v"))
    following = F.lead("_at", 1, run).over(Window.partitionBy("_run").orderBy("_at"))
    placed = there.unionByName(starts).repartition(tasks, "_run").withColumn("_to", F.greatest("_at", following - 1))
    cells = placed.select("_run", "_at", "v", F.explode(F.sequence("_at", "_to")).alias("_k")).where("_k >= 0")
    cells = cells.select((F.col("_run") * F.lit(run).cast("long") + F.col("_k")).alias("_n"), F.when(F.col("_k") == F.col("_at"), F.col("v")).otherwise(filled).alias("v")).where(F.col("_n") < total)
    places, step = [], 1
    for d, n in zip(own[::-1], node.shape[::-1]):
        places.append(F.expr(f"(_n div {step}L) % {max(n, 1)}L").alias(d))
        step *= max(n, 1)
    return cells.select(*places[::-1], "v")


def to_df(node: Node, dense: bool = False) -> DataFrame:
    """The relation of ``node``; with ``dense`` a row for every cell."""
    df = build(node)
    if node.implicit and dense:
        return densify(df, node)
    return df


def explicit(node: Node) -> DataFrame:
    """A relation that holds every cell."""
    return to_df(node, dense=True)


def build(node: Node) -> DataFrame:
    """The cells of ``node`` that are there."""
    if isinstance(node, Source):
        return node.cells(None)
    if isinstance(node, Subset):
        return _subset(node)
    if isinstance(node, Drop):
        kept = [k for k in range(len(node.seed.shape)) if k not in node.dimensions]
        return build(node.seed).select(*[F.col(f"d{k}").alias(f"d{i}") for i, k in enumerate(kept)], "v")
    if isinstance(node, Transpose):
        return build(node.seed).select(*[F.col(f"d{p}").alias(f"d{k}") for k, p in enumerate(node.perm)], "v")
    if isinstance(node, Combine):
        return _combine(node)
    if isinstance(node, Reduce):
        return _reduce(node)
    if isinstance(node, Binary):
        return _binary(node)
    base, steps = _chain(node)
    if steps:
        return _apply_chain(build(base), "v", steps)
    return _with_vector(node)


# --- elementwise ------------------------------------------------------------------------


def _pointwise(node: Node) -> bool:
    """Whether a node maps cells one by one, by an expression of the value (and the place)."""
    if isinstance(node, Cast | Round | Unary):
        return True
    if not isinstance(node, WithArgs) or (node.seed.implicit and not node.implicit):
        return False
    return node.along is None or (not isinstance(node.value, Node) and len(node.value) <= INLINE)


def _chain(node: Node) -> tuple[Node, list[Node]]:
    """The node below a run of pointwise nodes, and the run from the bottom up."""
    steps: list[Node] = []
    while _pointwise(node):
        steps.append(node)
        node = node.seed
    return node, steps[::-1]


def _step(node: Node, x: Column) -> Column:
    if isinstance(node, Cast):
        return numerics.cast(x, node.seed.dtype, node.dtype)
    if isinstance(node, Round):
        return numerics.round_to(x, node.dtype, node.decimals)
    if isinstance(node, Unary):
        return numerics.unary(node.operation, x, node.seed.dtype, node.dtype, node.masked)
    if node.along is None:
        other = literal(None if node.value is np.ma.masked else np.asarray(node.value)[()], node.value_dtype)
    else:
        values = [None if m else v for v, m in zip(np.ma.getdata(node.value), np.ma.getmaskarray(node.value))]
        other = F.element_at(F.array(*[literal(v, node.value_dtype) for v in values]), (F.col(f"d{node.along}") + 1).cast("int")) if values else literal(None, node.value_dtype)
    return _operate(node, x, other)


def _operate(node: WithArgs, x: Column, other: Column) -> Column:
    if node.right:
        return numerics.binary(node.operation, x, node.seed.dtype, other, node.value_dtype, node.dtype, node.masked)
    return numerics.binary(node.operation, other, node.value_dtype, x, node.seed.dtype, node.dtype, node.masked)


def _apply_chain(df: DataFrame, column: str, steps: list[Node]) -> DataFrame:
    for node in steps:
        df = df.withColumn(column, _step(node, F.col(column)))
    return df


def _with_vector(node: WithArgs) -> DataFrame:
    """A vector that isn't part of the expression is joined on its dimension."""
    own, at = dims(len(node.shape)), f"d{node.along}"
    if isinstance(node.value, Node):
        vector = explicit(node.value).select(F.col("d0").alias(at), F.col("v").alias("_w"))
    elif node.along is None:  # a scalar that makes absent cells matter
        return explicit(node.seed).withColumn("v", _step(node, F.col("v")))
    else:
        values = [None if m else v.item() for v, m in zip(np.ma.getdata(node.value), np.ma.getmaskarray(node.value))]
        vector = _session().createDataFrame(list(enumerate(values)), f"`{at}` long, _w {'double' if node.value_dtype.kind == 'f' else 'boolean' if node.value_dtype.kind == 'b' else 'decimal(20,0)' if node.value_dtype == np.dtype('uint64') else 'long'}")
        vector = vector.withColumn("_w", to_type(F.col("_w"), node.value_dtype))
    vector = small(vector, node.shape[node.along])
    if node.implicit:
        cells = build(node.seed)
        out = cells.join(vector, at).withColumn("v", _operate(node, F.col("v"), F.col("_w"))).select(*own, "v")
        if node.stored or not isinstance(node.value, Node):
            return out
        # slices whose absent cells do not stay what the others are
        fill = literal(node.fill, node.dtype)
        of_absent = _operate(node, literal(node.seed.fill, node.seed.dtype), F.col("_w"))
        other = vector.withColumn("v", of_absent).where(~F.col("v").eqNullSafe(fill)).select(at, "v")
        rest = tuple(n for k, n in enumerate(node.shape) if k != node.along)
        names = [c for c in own if c != at]
        places = grid(rest).select(*[F.col(f"d{k}").alias(c) for k, c in enumerate(names)]) if rest else None
        slices = other.crossJoin(places) if places is not None else other  # every cell of these slices is a row of the result
        return out.unionByName(slices.join(cells.select(*own), own, "left_anti").select(*own, "v"))
    return explicit(node.seed).join(vector, at).withColumn("v", _operate(node, F.col("v"), F.col("_w"))).select(*own, "v")


def _frame(node: Node) -> Node:
    """The node whose cells an elementwise expression maps one by one; the node itself
    if there is no such one."""
    if _pointwise(node):
        return _frame(node.seed)
    if isinstance(node, Binary):
        left = _frame(node.left)
        if left is _frame(node.right):
            return left
    return node


def _project(df: DataFrame, node: Node, base: Node, made: int = 0) -> tuple[DataFrame, str]:
    """``df`` with a column that holds ``node``, an expression over ``base``'s cells, and the
    column's name."""
    if node is base:
        return df, "v"
    if isinstance(node, Binary):
        df, left = _project(df, node.left, base)
        df, right = _project(df, node.right, base)
        value = numerics.binary(node.operation, F.col(left), node.left.dtype, F.col(right), node.right.dtype, node.dtype, node.masked)
    else:
        df, below = _project(df, node.seed, base)
        value = _step(node, F.col(below))
    name = f"_v{len(df.columns)}"
    return df.withColumn(name, value), name


# --- joins of arrays ---------------------------------------------------------------------


def _binary(node: Binary) -> DataFrame:
    own = dims(len(node.shape))
    operate = lambda a, b: numerics.binary(node.operation, a, node.left.dtype, b, node.right.dtype, node.dtype, node.masked)
    base = _frame(node)
    if base is not node:  # one scan and no join: all operands are projections of the same cells
        df, made = _project(build(base), node, base)
        return df.select(*own, F.col(made).alias("v"))
    a = build(node.left).select(*own, F.col("v").alias("_a"), F.lit(True).alias("_in_a"))
    b = build(node.right).select(*own, F.col("v").alias("_b"), F.lit(True).alias("_in_b"))
    how = {(False, False): "inner", (True, False): "right", (False, True): "left", (True, True): "full_outer"}[node.left.implicit, node.right.implicit]
    joined = a.join(b, own, how)
    x, y = F.col("_a"), F.col("_b")
    if node.left.implicit:  # a cell that is not there differs from one that is masked
        x = F.when(F.col("_in_a").isNull(), literal(node.left.fill, node.left.dtype)).otherwise(x)
    if node.right.implicit:
        y = F.when(F.col("_in_b").isNull(), literal(node.right.fill, node.right.dtype)).otherwise(y)
    return joined.select(*own, operate(x, y).alias("v"))


# --- subsets and combinations -----------------------------------------------------------------


def _is_whole(index, n: int) -> bool:
    return isinstance(index, range) and index == range(n)


def _subset(node: Subset) -> DataFrame:
    seed = node.seed
    if isinstance(seed, Combine):
        own = node.subset[seed.along]
        if isinstance(own, range) and own.step > 0:
            return _subset_of_combine(node, seed, own)
    if isinstance(seed, Source):
        df = seed.cells(tuple(s if isinstance(s, range) and s.step > 0 and len(s) else None for s in node.subset))
    else:
        df = build(seed)
    for k, (index, n) in enumerate(zip(node.subset, seed.shape)):
        if not _is_whole(index, n):
            df = _select(df, f"d{k}", index)
    return df


def _select(df: DataFrame, column: str, index) -> DataFrame:
    d = F.col(column)
    if len(index) == 0:
        return df.where(F.lit(False))
    if isinstance(index, range):
        low, high = min(index[0], index[-1]), max(index[0], index[-1])
        df = df.where((d >= low) & (d <= high))
        if abs(index.step) != 1 and len(index) > 1:
            df = df.where((d - low) % abs(index.step) == 0)
        step = index.step if len(index) > 1 else 1
        return df if step == 1 and low == 0 else df.withColumn(column, F.expr(f"(`{column}` - {index[0]}L) div {step}L"))
    old = np.asarray(index, np.int64)
    pairs = _session().createDataFrame([(int(o), k) for k, o in enumerate(old)], "_old long, _new long")
    df = df.where((d >= int(old.min())) & (d <= int(old.max())))  # reaches the scan, as the join does not
    names = df.columns
    return df.join(small(pairs, len(old)), F.col(column) == F.col("_old")).withColumn(column, F.col("_new")).select(*names)


def _subset_of_combine(node: Subset, seed: Combine, own: range) -> DataFrame:
    """Members that the subset does not touch are not read."""
    parts, done, offset = [], 0, 0
    for member in seed.seeds:
        n = member.shape[seed.along]
        before = _first(own, offset)
        count = _first(own, offset + n) - before
        if count:
            start = own[before] - offset
            index = tuple(range(start, start + (count - 1) * own.step + 1, own.step) if k == seed.along else s for k, s in enumerate(node.subset))
            parts.append(_member(Subset(member, index), seed, done))
            done += count
        offset += n
    if not parts:
        return _subset_empty(node)
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df


def _first(own: range, bound: int) -> int:
    """How many of an ascending range lie under ``bound``."""
    return min(len(own), max(0, -(-(bound - own.start) // own.step)))


def _subset_empty(node: Node) -> DataFrame:
    return _session().createDataFrame([], ", ".join(f"{d} long" for d in dims(len(node.shape))) + f", v {spark_type(node.dtype)}")


def _member(member: Node, whole: Combine, offset: int) -> DataFrame:
    """A member's cells in the place and type that they have in the whole."""
    df = build(member) if whole.implicit or not member.implicit else densify(build(member), member)
    at = f"d{whole.along}"
    moved = df.withColumn(at, F.col(at) + F.lit(offset).cast("long")) if offset else df
    return moved.withColumn("v", numerics.cast(F.col("v"), member.dtype, whole.dtype))


def _combine(node: Combine) -> DataFrame:
    df, offset = None, 0
    for member in node.seeds:
        part = _member(member, node, offset)
        df = part if df is None else df.unionByName(part)
        offset += member.shape[node.along]
    return df


# --- reductions ----------------------------------------------------------------------------------


def _reduce(node: Reduce) -> DataFrame:
    """One aggregation, partial before the shuffle. Absent cells enter by their number and
    fill; groups of absent cells only are absent from the result."""
    seed = node.seed
    kept = [k for k in range(len(seed.shape)) if k not in node.axes]
    keys = [F.col(f"d{k}").alias(f"d{i}") for i, k in enumerate(kept)]
    v = F.col("v")
    number = numerics.cast(v, seed.dtype, np.dtype("int64")) if seed.dtype.kind in "biu" and seed.dtype != np.dtype("uint64") else v
    real = number.cast("double")
    total_kind = node.dtype.kind
    summed = F.sum(number if total_kind in "iu" and seed.dtype.kind in "biu" else real)
    cells = {"rows": F.count("*"), "n": F.count("v"), "s": summed}
    if node.operation == "var":
        cells |= {"m": F.avg(real), "q": F.var_pop(real)}
    if node.operation in ("any", "all"):
        cells = {"rows": F.count("*"), "n": F.count("v"), "t": F.max(numerics.truth(v, seed.dtype)), "f": F.min(numerics.truth(v, seed.dtype))}
    grouped = build(seed).groupBy(*keys).agg(*[c.alias(f"_{k}") for k, c in cells.items()])
    if not kept:
        grouped = grouped.where("_rows > 0")  # no cell at all: the result is absent, too
    rows, n = F.col("_rows"), F.col("_n")
    absent = F.lit(node.n).cast("long") - rows if seed.implicit and seed.fill is not None else F.lit(0).cast("long")
    fill = 0.0 if seed.fill is None else seed.fill
    size = n + absent  # cells that count
    empty = literal(None, node.dtype) if node.masked else None
    if node.operation == "sum":
        if total_kind in "iu" and seed.dtype.kind in "biu":
            share = literal(int(fill), np.dtype("int64")) * absent if int(fill) else None
            value = F.coalesce(F.col("_s"), F.lit(0)) + share if share is not None else F.coalesce(F.col("_s"), F.lit(0))
        else:
            value = F.coalesce(F.col("_s").cast("double"), F.lit(0.0)) + (F.when(absent > 0, F.lit(float(fill)) * absent).otherwise(0.0) if fill != 0 else F.lit(0.0))
        out = to_type(value, node.dtype)
        out = F.when(size > 0, out).otherwise(empty) if node.masked else out
    elif node.operation == "mean":
        total = F.coalesce(F.col("_s").cast("double"), F.lit(0.0)) + (F.when(absent > 0, F.lit(float(fill)) * absent).otherwise(0.0) if fill != 0 else F.lit(0.0))
        out = F.when(size > 0, to_type(total / F.when(size > 0, size), node.dtype)).otherwise(empty if node.masked else literal(np.nan, node.dtype))
    elif node.operation == "var":
        # squares about the mean of the cells that are there, then those about the common mean
        mean, own = F.coalesce(F.col("_m"), F.lit(0.0)), F.coalesce(F.col("_q"), F.lit(0.0)) * n
        gap = mean - F.lit(float(fill))
        between = F.when((n > 0) & (absent > 0), gap * gap * (n * absent.cast("double")) / F.when(size > 0, size)).otherwise(0.0) if seed.implicit else F.lit(0.0)
        free = size - node.ddof
        out = F.when(free > 0, to_type((own + between) / F.when(free > 0, free), node.dtype)).otherwise(empty if node.masked else literal(np.nan, node.dtype))
    else:
        true = bool(fill)
        if node.operation == "any":
            out = F.coalesce(F.col("_t"), F.lit(False)) | ((absent > 0) if true else F.lit(False))
        else:
            out = F.coalesce(F.col("_f"), F.lit(True)) & (F.lit(True) if true else absent <= 0)
        out = F.when(size > 0, out).otherwise(empty) if node.masked else out
    return grouped.select(*dims(len(kept)), out.alias("v"))
