"""Arguments of NumPy's functions, exact integer powers, registered types and matrix objects."""

import sys
import types

import numpy as np
import pytest

import tessera
from tests.helpers import dense, lazy_sparse, same, sparse

X = dense((4, 5), 1)


@pytest.fixture(scope="module")
def x(spark):
    return tessera.from_numpy(spark, X)


def test_arguments_are_honoured_or_refused(x):
    same(np.sum(x, 0, np.float32), np.sum(X, 0, np.float32))
    same(np.var(x, axis=1, ddof=1, out=None, keepdims=False), np.var(X, axis=1, ddof=1))
    same(np.any(x > 5, axis=0, where=True), np.any(X > 5, axis=0))
    same(np.round(x, 1), np.round(X, 1))
    same(np.concatenate([x, X], axis=1), np.concatenate([X, X], axis=1))
    for call in (
        lambda: np.sum(x, axis=0, keepdims=True),
        lambda: np.sum(x, where=X > 0),
        lambda: np.sum(x, initial=3),
        lambda: np.mean(x, 0, None, np.zeros(5)),
        lambda: np.add(x, 1, dtype="float32"),
        lambda: np.add(x, 1, where=X > 0),
        lambda: np.exp(x, out=np.zeros((4, 5))),
        lambda: np.concatenate([x, X], dtype="float32"),
    ):
        with pytest.raises(TypeError):
            call()


def test_types_of_any_and_all(x):
    same(x.any(axis=0, dtype=np.int32), (X != 0).any(axis=0).astype(np.int32))
    same((x > 0).all(axis=1, dtype=np.float64), (X > 0).all(axis=1).astype(float))


@pytest.mark.parametrize("dtype", ["int64", "int32", "int8", "uint8"])
def test_integer_powers_are_exact(spark, dtype):
    a = np.array([0, 1, 2, 3, 5, 7, 10], dtype)
    b = np.array([0, 39, 30, 25, 25, 11, 15], dtype)
    lazy = tessera.from_numpy(spark, a)
    same(lazy ** tessera.from_numpy(spark, b), a**b, exact=True)
    same(lazy**3, a**3, exact=True)
    same(3**lazy, 3**a, exact=True)
    if dtype != "uint8":
        same((-lazy) ** 3, (-a) ** 3, exact=True)


def test_negative_integer_powers_are_refused(spark):
    a = tessera.from_numpy(spark, np.array([2, 3]))
    with pytest.raises(Exception, match="negative integer powers"):
        (a ** tessera.from_numpy(spark, np.array([-1, 2]))).to_numpy()


def test_fabs_gives_floats(spark):
    a = np.array([-3, 2, 0])
    same(np.fabs(tessera.from_numpy(spark, a)), np.fabs(a))


def test_conversion_copy_and_text(x, spark, monkeypatch):
    same(np.asarray(x, dtype="float32"), X.astype("float32"))
    assert x.copy() is not x and x.copy().node is x.node
    assert str(x).startswith(repr(x)) and "array(" in str(x)
    monkeypatch.setattr(tessera.array, "COLLECTED", 0)
    same(x.T.to_numpy(), X.T)
    same(tessera.from_numpy(spark, np.array([[1, 2**64 - 1]], "uint64")).to_numpy(), np.array([[1, 2**64 - 1]], "uint64"))


class Matrix:
    """A matrix object as sparse libraries make them."""

    def __init__(self, format, shape, **vectors):
        self.format, self.shape = format, shape
        self.__dict__.update(vectors)


def test_matrix_objects(spark):
    S = sparse((6, 4), 3)
    S[0, 0] = 2.5
    want = lazy_sparse(spark, S)
    data = tessera.to_sparse_matrix(want, "csr")
    csr = Matrix("csr", S.shape, indptr=data["indptr"], indices=data["indices"].astype("int32"), data=data["data"])
    data = tessera.to_sparse_matrix(want, "csc")
    csc = Matrix("csc", S.shape, indptr=data["indptr"], indices=data["indices"].astype("int32"), data=data["data"])
    data = tessera.to_sparse_matrix(want, "coo")
    coo = Matrix("coo", S.shape, row=data["row"].astype("int32"), col=data["col"].astype("int32"), data=data["data"])
    for matrix in (csr, csc, coo):
        made = tessera.wrap(matrix)
        assert made.is_sparse and tessera.is_sparse(matrix) and made.seed is matrix
        assert made.index_dtype == np.dtype("int32") == (made * 2).T[1:3].index_dtype
        same(made, S)
        (i, j), values = tessera.extract_sparse_array(matrix)
        assert (S[i, j] == values).all() and len(values) == (S != 0).sum()


def test_types_are_registered(spark):
    class Ramp:
        n = 7

    @tessera.wrap.register
    def _(x: Ramp):
        return tessera.from_numpy(spark, np.arange(float(x.n)))

    @tessera.chunk_grid.register
    def _(x: Ramp):
        return tessera.SimpleGrid((range(1, x.n + 1),), 1.0)

    same(tessera.wrap(Ramp()) * 2, np.arange(7.0) * 2)
    assert tessera.chunk_grid(Ramp()).shape == (7,)
    for call in (tessera.extract_dense_array, tessera.extract_sparse_array, tessera.chunk_grid, tessera.is_masked):
        with pytest.raises(NotImplementedError):
            call("text")


def test_dask_is_asked_for_blocks(x, monkeypatch):
    seen = {}
    made = types.ModuleType("dask.array")
    made.from_array = lambda a, chunks, **_: seen.update(chunks=chunks) or np.block([[np.asarray(a[0:4, 0:5])]])
    package = types.ModuleType("dask")
    package.array = made
    monkeypatch.setitem(sys.modules, "dask", package)
    monkeypatch.setitem(sys.modules, "dask.array", made)
    same(tessera.create_dask_array(x), X)
    assert [sum(c) for c in seen["chunks"]] == [4, 5]


def test_compressed_rows_are_split(spark, monkeypatch):
    from tessera.operators import export

    S = sparse((3, 40), 5, density=0.8)
    monkeypatch.setattr(export, "PART", 16)
    rows = tessera.to_csr(lazy_sparse(spark, S)).collect()
    assert max(len(r["indices"]) for r in rows) <= 16 and {r["part"] for r in rows} == {0, 1, 2}
    assert sorted((r["major"], i, v) for r in rows for i, v in zip(r["indices"], r["values"])) == [(i, j, S[i, j]) for i in range(3) for j in range(40) if S[i, j]]
