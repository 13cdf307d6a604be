"""Elementwise operations against NumPy on the same data."""

import operator

import numpy as np
import pytest
from helpers import dense, lazy_sparse, same, sparse

import tessera
from tessera import from_numpy, is_masked, is_sparse
from tessera.functions.numerics import BINARY, UNARY

SPECIAL = np.array([0, 1, -1, 0.1, -0.1, 0.5, -0.5, 2.5, -2.5, 3, -3, 7, -7, 0.15, 2.675, 1e20, np.inf, -np.inf, np.nan])


def all_of(arrays):
    """Cells of several arrays of one shape in one Spark job each would be slow: they are
    stacked and collected at once where types agree."""
    return [a.to_numpy() for a in arrays]


@pytest.mark.parametrize("operation", UNARY)
def test_unary(spark, operation):
    f = getattr(np, operation)
    with np.errstate(all="ignore"):
        same(f(from_numpy(spark, SPECIAL)).to_numpy(), f(SPECIAL))
        masked = np.ma.masked_array(SPECIAL[:-3], SPECIAL[:-3] == 7)
        same(f(from_numpy(spark, masked)).to_numpy(), getattr(np.ma, operation, f)(masked))
        ints = np.array([-3, 0, 1, 5, 120], np.int32)
        if operation != "isnan":
            same(f(from_numpy(spark, ints)).to_numpy(), f(ints))


@pytest.mark.parametrize("operation", UNARY)
def test_unary_sparse(spark, operation):
    f = getattr(np, operation)
    x = sparse((6, 5), 1) / 10
    lazy = f(lazy_sparse(spark, x))
    with np.errstate(all="ignore"):
        same(lazy.to_numpy(), f(x))
        assert is_sparse(lazy) == (f(np.zeros(1))[0] == 0)


@pytest.mark.parametrize("operation", BINARY)
def test_pairs_of_special_numbers(spark, operation):
    f = getattr(np, operation)
    a, b = (m.ravel() for m in np.meshgrid(SPECIAL, SPECIAL))
    with np.errstate(all="ignore"):
        same((f(from_numpy(spark, a), from_numpy(spark, b))).to_numpy(), f(a, b))


@pytest.mark.parametrize("operation", BINARY)
def test_integers(spark, operation):
    f = getattr(np, operation)
    a, b = (m.ravel() for m in np.meshgrid(np.array([-7, -1, 0, 1, 7, 100], np.int32), np.array([0, 1, 2, 3], np.int32)))
    with np.errstate(all="ignore"):
        same(f(from_numpy(spark, a), from_numpy(spark, b)).to_numpy(), f(a, b))


@pytest.mark.parametrize("operation", BINARY)
def test_masked_both_sides(spark, operation):
    f = getattr(np, operation)
    a, b = dense((7, 4), 2, 0.3), dense((7, 4), 3, 0.3)
    if operation == "power":
        a = abs(a)
    with np.errstate(all="ignore"):
        want = getattr(np.ma, operation)(a, b)
        same(f(from_numpy(spark, a), from_numpy(spark, b)).to_numpy(), np.ma.masked_array(want))


@pytest.mark.parametrize("mask_rate", [0, 0.3])
@pytest.mark.parametrize("operation", BINARY)
def test_sparse_pairs(spark, operation, mask_rate):
    f = getattr(np, operation)
    a, b = sparse((6, 5), 4, mask_rate), sparse((6, 5), 5)
    if operation == "power":
        b = abs(b)
        a = abs(a)
    lazy = f(lazy_sparse(spark, a), lazy_sparse(spark, b))
    with np.errstate(all="ignore"):
        want = getattr(np.ma, operation)(a, b) if mask_rate else f(a, b)
        same(lazy.to_numpy(), want)
        zero = f(np.zeros(1), np.zeros(1))[0]
    assert is_sparse(lazy) == bool(zero == 0) or mask_rate
    assert is_masked(lazy) == bool(mask_rate)


@pytest.mark.parametrize("operation", BINARY)
def test_sparse_with_dense(spark, operation):
    f = getattr(np, operation)
    a, b = sparse((6, 5), 6), abs(dense((6, 5), 7)) + 0.5
    with np.errstate(all="ignore"):
        if operation == "power":
            a = abs(a)
        same(f(lazy_sparse(spark, a), from_numpy(spark, b)).to_numpy(), f(a, b))
        same(f(from_numpy(spark, b), lazy_sparse(spark, a)).to_numpy(), f(b, a))


@pytest.mark.parametrize("operation", BINARY)
def test_scalars_and_vectors(spark, operation):
    f = getattr(np, operation)
    x, s = abs(dense((5, 4), 8)) + 0.25, abs(sparse((5, 4), 9))
    row, column = np.array([0.5, 2, 3, 0.75]), np.arange(1.0, 6)[:, None]
    with np.errstate(all="ignore"):
        for lazy, local in ((from_numpy(spark, x), x), (lazy_sparse(spark, s), s)):
            for other in (2.5, row, column):
                same(f(lazy, other).to_numpy(), f(local, other))
                same(f(other, lazy).to_numpy(), f(other, local))


def test_operators(spark):
    x = dense((4, 3), 10)
    lazy = from_numpy(spark, x)
    for op in (operator.add, operator.sub, operator.mul, operator.truediv, operator.mod, operator.floordiv, operator.eq, operator.ne, operator.lt, operator.le, operator.gt, operator.ge):
        same(op(lazy, 2.0).to_numpy(), op(x, 2.0))
        same(op(2.0, lazy).to_numpy(), op(2.0, x))
    same((lazy**2).to_numpy(), x**2)
    same((2.0**lazy).to_numpy(), 2.0**x)
    same((-lazy).to_numpy(), -x)
    same(abs(lazy).to_numpy(), abs(x))
    same((lazy & 1).to_numpy(), np.logical_and(x, 1))
    same((0 | lazy).to_numpy(), np.logical_or(0, x))


def test_subtract_keeps_its_sides(spark):
    s = sparse((4, 3), 11)
    same(np.subtract(lazy_sparse(spark, s), 5).to_numpy(), s - 5)
    same(np.subtract(5, lazy_sparse(spark, s)).to_numpy(), 5 - s)


def test_division_of_a_scalar_by_a_sparse_array_is_not_sparse(spark):
    s = sparse((4, 3), 12)
    lazy = 5 / lazy_sparse(spark, s)
    assert not is_sparse(lazy)
    with np.errstate(all="ignore"):
        same(lazy.to_numpy(), 5 / s)


def test_masked_operands(spark):
    x = dense((4, 3), 13)
    row = np.ma.masked_array([1.0, 2, 3], [False, True, False])
    same((from_numpy(spark, x) + row).to_numpy(), np.ma.masked_array(x + row))
    same((lazy_sparse(spark, np.where(x > 0, x, 0)) * row).to_numpy(), np.where(x > 0, x, 0) * row)
    assert np.ma.getmaskarray((from_numpy(spark, x) == np.ma.masked).to_numpy()).all()
    same(np.add(row, from_numpy(spark, x)).to_numpy(), np.ma.masked_array(row + x))


def test_distributed_vectors(spark):
    s = sparse((6, 5), 14, density=0.5)
    s[:, 2] = 0
    lazy = lazy_sparse(spark, s)
    with np.errstate(all="ignore"):
        got = lazy / lazy.sum(axis=0)
        same(got.to_numpy(), s / s.sum(axis=0))
        assert got.node.implicit
        same((lazy - lazy.mean(axis=0)).to_numpy(), s - s.mean(axis=0))


def test_long_vectors_are_joined(spark):
    x = dense((3, 100), 15)
    v = np.arange(100) + 1.0
    same((from_numpy(spark, x) * v).to_numpy(), x * v)
    s = sparse((3, 100), 16)
    same((lazy_sparse(spark, s) + v).to_numpy(), s + v)


@pytest.mark.parametrize("dtype", ["bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64"])
def test_cast(spark, dtype):
    x = np.array([0.0, 1.7, 3.2, 100.9])
    same(from_numpy(spark, x).astype(dtype).to_numpy(), x.astype(dtype))
    same(from_numpy(spark, x.astype(dtype)).astype("float64").to_numpy(), x.astype(dtype).astype("float64"))
    s = sparse((4, 3), 17)
    assert is_sparse(lazy_sparse(spark, s).astype("float32"))


def test_small_integers_wrap(spark):
    x = np.array([127, -128, 5], np.int8)
    same((from_numpy(spark, x) + np.int8(1)).to_numpy(), x + np.int8(1))
    same((from_numpy(spark, x) * x).to_numpy(), x * x)
    u = np.array([255, 0, 7], np.uint8)
    same((from_numpy(spark, u) + np.uint8(1)).to_numpy(), u + np.uint8(1))


@pytest.mark.parametrize("decimals", [0, 1, 2, -1])
def test_round(spark, decimals):
    x = np.array([0.5, 1.5, 2.5, -0.5, 2.675, 125.0, 0.15, np.inf, np.nan])
    same(np.round(from_numpy(spark, x), decimals=decimals).to_numpy(), np.round(x, decimals))
    same(np.round(from_numpy(spark, x), decimals).to_numpy(), np.round(x, decimals))
    i = np.array([125, 135, -125, 4])
    same(from_numpy(spark, i).round(decimals).to_numpy(), np.round(i, decimals))


def test_truth_values(spark):
    a, b = dense((4, 3), 18, dtype=bool), dense((4, 3), 19, dtype=bool)
    for f in (np.add, np.multiply, np.logical_xor, np.equal):
        same(f(from_numpy(spark, a), from_numpy(spark, b)).to_numpy(), f(a, b))
    with pytest.raises(TypeError):
        np.subtract(from_numpy(spark, a), from_numpy(spark, b))


def test_errors(spark):
    x = from_numpy(spark, dense((4, 3), 20))
    with pytest.raises(NotImplementedError):
        np.square(x)
    with pytest.raises(NotImplementedError):
        np.cumsum(x)
    with pytest.raises(ValueError):
        x + np.ones((2, 4, 3))
    with pytest.raises(ValueError):
        x + np.ones((4, 2))
    with pytest.raises(ValueError):
        tessera.Binary(x.node, x.T.node, "add")


def test_elementwise_chains_need_no_shuffle(spark):
    x = from_numpy(spark, dense((4, 3), 21))
    plan = (np.log1p(abs(x)) * x + x).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
