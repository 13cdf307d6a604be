"""Grids, block functions, sources and exports."""

import numpy as np
import pandas as pd
import pytest
from helpers import dense, lazy_sparse, same, sparse

import tessera
from tessera import CompositeGrid, RegularTicks, SimpleGrid, chunk_grid, from_numpy

X = dense((12, 7), 1)
S = sparse((12, 7), 2)


def test_ticks():
    assert list(RegularTicks(7, 50)) == [7, 14, 21, 28, 35, 42, 49, 50]
    assert list(RegularTicks(100, 50)) == [50] and list(RegularTicks(1, 0)) == []
    t = RegularTicks(7, 50)
    assert t[-1] == 50 and t[0] == 7 and t[1:3] == [14, 21]
    with pytest.raises(IndexError):
        t[8]
    with pytest.raises(ValueError):
        RegularTicks(0, 5)


GRIDS = [
    SimpleGrid([range(10, 51, 10), range(2, 21, 3)], 1.0),
    SimpleGrid([[7, 8, 30], [20]], 1.0),
    SimpleGrid([RegularTicks(3, 11), RegularTicks(4, 9), RegularTicks(2, 6)], 1.0),
    CompositeGrid([SimpleGrid([[5, 10], [6]], 1.0), SimpleGrid([[4], [3, 6]], 2.0)], 0),
]


@pytest.mark.parametrize("buffer", [1, 5, 10, 50, 100, 500, 1e6])
@pytest.mark.parametrize("k", range(len(GRIDS)))
def test_each_cell_once_within_the_buffer(k, buffer):
    grid = GRIDS[k]
    seen = np.zeros(grid.shape, int)
    for job in grid.iterate(buffer_elements=buffer):
        seen[tuple(slice(a, b) for a, b in job)] += 1
        assert np.prod([b - a for a, b in job]) <= buffer
    assert (seen == 1).all()


def test_grid_of_listed_dimensions():
    for job in GRIDS[0].iterate(dimensions=[1], buffer_elements=200):
        assert job[0] == (0, 50)
    assert GRIDS[0].transpose((1, 0)).shape == GRIDS[0].shape[::-1]
    assert SimpleGrid([[], [3]], 1.0).shape == (0, 3) and list(SimpleGrid([[], [3]], 1.0).iterate()) == []
    with pytest.raises(ValueError):
        SimpleGrid([[3, 3]], 1.0)


def test_grid_subset():
    g = SimpleGrid([[4, 8, 12]], 1.0)
    assert list(g.subset([[0, 1, 5, 6, 11, 2]]).boundaries[0]) == [2, 4, 5, 6]
    assert list(g.subset([None]).boundaries[0]) == [4, 8, 12]
    c = CompositeGrid([SimpleGrid([[4], [2]], 1.0), SimpleGrid([[6], [2]], 1.0)], 0)
    assert c.subset([[3, 4, 5], None]).shape == (3, 2)  # 4 is the second component's first
    assert list(c.subset([[3, 4, 5], None]).boundaries[0]) == [1, 3]
    assert c.transpose((1, 0)).along == 1 and c.cost == 20


def test_grids_follow_the_tree(spark):
    x, s = from_numpy(spark, X), lazy_sparse(spark, S)
    assert chunk_grid(x).shape == X.shape and chunk_grid(s).cost == 1.5 * S.size
    assert chunk_grid(x.T + 1).shape == (7, 12) and chunk_grid(x[::2]).shape == (6, 7)
    assert chunk_grid(x + s).cost == 1.5 * S.size
    assert isinstance(chunk_grid(np.concatenate([x, x])), CompositeGrid)
    with pytest.raises(NotImplementedError):
        chunk_grid(3)


@pytest.mark.parametrize("buffer", [100, 1000, 1e8])
def test_apply(spark, buffer):
    for local, lazy in ((X, from_numpy(spark, X)), (S, lazy_sparse(spark, S)), (dense((12, 7), 3, 0.3), None)):
        lazy = from_numpy(spark, local) if lazy is None else lazy
        got = tessera.apply_over_blocks(lazy, lambda job, block: (job, block), buffer_size=buffer)
        whole = np.ma.zeros(local.shape)
        for job, block in got:
            whole[tuple(slice(a, b) for a, b in job)] = block
        same(np.ma.masked_array(whole), np.ma.masked_array(local))
        sums = tessera.apply_over_dimension(lazy, 0, lambda job, block: (job, block.sum(axis=1)), buffer_size=buffer)
        assert [j for j, _ in sums][0][0] == 0
        np.testing.assert_allclose(np.ma.concatenate([v for _, v in sums]).filled(0), np.ma.masked_array(local).sum(axis=1).filled(0))


def test_sparse_blocks_and_local_blocks(spark):
    s = lazy_sparse(spark, S)
    got = tessera.apply_over_blocks(s, lambda job, block: block[1].sum(), allow_sparse=True, buffer_size=200)
    assert sum(got) == pytest.approx(S.sum())
    kept = []
    for job, block in tessera.blocks(s, buffer_size=200):
        kept.append(block.sum())
        same(block, S[tuple(slice(a, b) for a, b in job)])
    assert sum(kept) == pytest.approx(S.sum())
    table = tessera.map_blocks(s, lambda job, block: pd.DataFrame({"start": [job[0][0]], "total": [block.sum()]}), "start long, total double", buffer_size=200)
    assert table.toPandas()["total"].sum() == pytest.approx(S.sum())


def test_sparse_trees(spark):
    contents = [None, (np.array([0, 3]), np.array([1.5, -2.0])), (np.array([2]), np.array([4.0]))]
    x = tessera.sparse_ndarray(spark, (5, 3), contents)
    want = np.zeros((5, 3))
    want[[0, 3], 1], want[2, 2] = [1.5, -2], 4
    same(x.to_numpy(), want)
    back = tessera.contents(x)
    assert back[0] is None and back[1][0].tolist() == [0, 3] and back[2][1].tolist() == [4.0]
    deep = tessera.sparse_ndarray(spark, (4, 2, 3), [None, [(np.array([1]), np.array([7])), None], None])
    assert deep.to_numpy()[1, 0, 1] == 7 and deep.dtype == np.int64
    flat = tessera.sparse_ndarray(spark, (6,), (np.array([2, 5]), np.array([1.0, 2.0])))
    same(flat.to_numpy(), np.array([0, 0, 1.0, 0, 0, 2]))
    empty = tessera.sparse_ndarray(spark, (3, 2), None, dtype="float64")
    same(empty.to_numpy(), np.zeros((3, 2)))
    assert tessera.contents(empty) is None and len(tessera.to_sparse_matrix(empty, "coo")["data"]) == 0
    for bad in ([None], [None, (np.array([0, 0]), np.array([1.0, 2.0])), None], [None, (np.array([9]), np.array([1.0])), None], [None, (np.array([0]), np.array([1.0, 2.0])), None]):
        with pytest.raises(ValueError):
            tessera.sparse_ndarray(spark, (5, 3), bad)
    with pytest.raises(ValueError):
        tessera.sparse_ndarray(spark, (5, 3), None)


def test_matrix_formats(spark):
    s = lazy_sparse(spark, S)
    csc, csr, coo = (tessera.to_sparse_matrix(s, f) for f in ("csc", "csr", "coo"))
    for made in (tessera.from_csc(spark, S.shape, csc["indptr"], csc["indices"], csc["data"]), tessera.from_csr(spark, S.shape, csr["indptr"], csr["indices"], csr["data"]), tessera.from_coo(spark, S.shape, coo["row"], coo["col"], coo["data"])):
        same(made.to_numpy(), S)
    assert chunk_grid(tessera.from_coo(spark, S.shape, coo["row"], coo["col"], coo["data"])).cost == 5 * S.size
    rows = {r["major"]: dict(zip(r["indices"], r["values"])) for r in tessera.to_csr(s).collect()}
    assert all(rows[i][j] == S[i, j] for i in rows for j in rows[i]) and sum(map(len, rows.values())) == (S != 0).sum()
    assert tessera.to_csc(s).count() == (S != 0).any(axis=0).sum() and tessera.to_coo(s).count() == (S != 0).sum()
    same(tessera.extract_dense_array(s, (slice(1, 4), [2, 0])), S[1:4][:, [2, 0]])
    with pytest.raises(NotImplementedError):
        tessera.extract_sparse_array(from_numpy(spark, X))


def test_tables(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (2, 0, 1.0)], "a long, b int, x double")
    t = tessera.from_table(df, ["a", "b"], "x", (3, 2), aggregate="sum")
    same(t.to_numpy(), np.array([[0, 5], [0, 0], [1, 0.0]]))
    assert tessera.validate(t) == {"outside": 0, "repeated": 0}
    assert tessera.validate(tessera.from_table(df, ["a", "b"], "x", (2, 2))) == {"outside": 1, "repeated": 1}
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(X)], "id long, values array<double>")
    a = tessera.from_array_column(rows, "id", "values", X.shape)
    same(a.to_numpy(), X)
    same(a[3:9, 2:6].to_numpy(), X[3:9, 2:6])
    same(a[::-1, 6:1:-2].to_numpy(), X[::-1, 6:1:-2])


def test_streams(spark, tmp_path):
    from tessera.streaming import stream_df

    tessera.write_parquet(from_numpy(spark, X), str(tmp_path / "in"))
    stream = spark.readStream.schema("d0 long, d1 long, v double").parquet(str(tmp_path / "in"))
    x = tessera.from_table(stream, ["d0", "d1"], "v", X.shape, sparse=False)
    query = stream_df(np.log1p(abs(x[2:6] * 2)).T).writeStream.format("memory").queryName("cells").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = np.zeros((7, 4))
    for r in spark.table("cells").collect():
        got[r["d0"], r["d1"]] = r["v"]
    same(got, np.log1p(abs(X[2:6] * 2)).T)
    with pytest.raises(NotImplementedError):
        stream_df(x.sum(axis=0))
