"""Subsets, transposes, combinations, reductions and what is known without data."""

import numpy as np
import pytest
from helpers import dense, lazy_sparse, same, sparse

import tessera
from tessera import Combine, Subset, Transpose, from_numpy, is_masked, is_pristine, is_sparse
from tessera.plans import nodes

X = dense((6, 5, 4), 1)
M = dense((6, 5, 4), 2, 0.3)
S = sparse((6, 5, 4), 3)

INDEXES = [
    (slice(None), slice(None), slice(None)),
    (slice(1, 6, 2), slice(None, None, -1), slice(1, 3)),
    (slice(5, 0, -2),),
    (slice(1, 4), [3, 0, 0, -1]),
    (np.array([True, False, True, True, False, False]),),
    (2, slice(1, 4), slice(None)),
    (slice(None), -1, [2, 1]),
    (slice(0, 0), slice(None), slice(None)),
    (range(4, 0, -1),),
    (..., 1),
]


@pytest.mark.parametrize("k", range(len(INDEXES)))
def test_index(spark, k):
    index = INDEXES[k]
    for local, lazy in ((X, from_numpy(spark, X)), (M, from_numpy(spark, M)), (S, lazy_sparse(spark, S))):
        want = local[tuple(list(i) if isinstance(i, range) else i for i in index)]
        same(lazy[index].to_numpy(), want, exact=True)


def test_open_mesh_and_orthogonal_lists(spark):
    x = from_numpy(spark, X)
    mesh = np.ix_([4, 1, 1], [0, -1], [True, False, True, True])
    same(x[mesh].to_numpy(), X[mesh])
    same(x[[4, 1], [0, 2], :].to_numpy(), X[np.ix_([4, 1], [0, 2])])  # lists cross, they do not pair
    same(x[0, 2:5].to_numpy(), X[0, 2:5])


def test_index_errors(spark):
    x = from_numpy(spark, X)
    with pytest.raises(ValueError):
        x[0, 0, 0, 0]
    with pytest.raises(NotImplementedError):
        x[np.array([[0, 1]])]
    with pytest.raises(IndexError):
        x[9]
    with pytest.raises(NotImplementedError):
        x[x[:, 0, 0] > 0]
    with pytest.raises(ValueError):
        Subset(x.node, (range(6),))


def test_subsets_fuse(spark):
    x = from_numpy(spark, X)
    twice = x[1:6][::2, 1:]
    assert isinstance(twice.node, Subset) and isinstance(twice.node.seed, nodes.Source)
    same(twice.to_numpy(), X[1:6][::2, 1:])
    back = x[::-1][::-1]
    assert back.is_pristine
    mixed = x[[5, 3, 1]][1:]
    same(mixed.to_numpy(), X[[5, 3, 1]][1:])
    assert isinstance(mixed.node.seed, nodes.Source)


def test_transpose(spark):
    x = from_numpy(spark, X)
    same(x.T.to_numpy(), X.T)
    same(np.transpose(x, axes=(1, 2, 0)).to_numpy(), X.transpose(1, 2, 0))
    same(np.transpose(x, (1, 2, 0)).to_numpy(), X.transpose(1, 2, 0))
    same(lazy_sparse(spark, S).T.to_numpy(), S.T)
    assert x.T.T.is_pristine
    once = x.transpose((1, 2, 0)).transpose((1, 2, 0))
    assert isinstance(once.node, Transpose) and isinstance(once.node.seed, nodes.Source)
    same(once.to_numpy(), X.transpose(1, 2, 0).transpose(1, 2, 0))
    with pytest.raises(ValueError):
        x.transpose((0, 1))
    v = from_numpy(spark, X[0, 0])
    same(v.T.to_numpy(), X[0, 0])


@pytest.mark.parametrize("axis", [0, 1, -1])
def test_concatenate(spark, axis):
    y = dense((6, 5, 4), 4, dtype="int32")
    for parts, lazies in (([X, y], [from_numpy(spark, X), from_numpy(spark, y)]), ([S, S], [lazy_sparse(spark, S)] * 2), ([S, X], [lazy_sparse(spark, S), from_numpy(spark, X)]), ([M, X], [from_numpy(spark, M), from_numpy(spark, X)])):
        got = np.concatenate(lazies, axis=axis)
        module = np.ma if any(isinstance(p, np.ma.MaskedArray) for p in parts) else np
        same(got.to_numpy(), module.concatenate(parts, axis=axis), exact=True)
        same(got[2:9, 1:7][::-1].to_numpy() if axis == 0 else got[2:9, 1:7].to_numpy(), module.concatenate(parts, axis=axis)[2:9, 1:7][::-1] if axis == 0 else module.concatenate(parts, axis=axis)[2:9, 1:7], exact=True)


def test_concatenations_flatten(spark):
    x = from_numpy(spark, X)
    joined = np.concatenate([np.concatenate([x, x]), x])
    assert isinstance(joined.node, Combine) and len(joined.node.seeds) == 3
    assert np.concatenate([x]).is_pristine
    assert is_sparse(np.concatenate([lazy_sparse(spark, S)] * 2))
    assert not is_sparse(np.concatenate([lazy_sparse(spark, S), x]))
    with pytest.raises(ValueError):
        np.concatenate([x, from_numpy(spark, X[:, :2])])


def test_members_outside_a_slice_are_not_read(spark):
    read = []

    def member(name):
        source = from_numpy(spark, X).node
        return tessera.LazyArray(nodes.Source(lambda subset: (read.append(name), source.cells(subset))[1], source.shape, source.dtype))

    joined = np.concatenate([member("a"), member("b"), member("c")])
    same(joined[7:11].to_numpy(), np.concatenate([X, X, X])[7:11])
    assert read == ["b"]
    same(joined[12:3:-1].to_numpy(), np.concatenate([X, X, X])[12:3:-1])
    same(joined[18:18].to_numpy(), np.concatenate([X, X, X])[18:18])


@pytest.mark.parametrize("axis", [None, 0, 1, 2, (0, 1), (0, 2), (-1,), (0, 1, 2)])
def test_reductions(spark, axis):
    masked_sparse = sparse((6, 5, 4), 5, 0.5)
    for local, lazy in ((X, from_numpy(spark, X)), (M, from_numpy(spark, M)), (S, lazy_sparse(spark, S)), (masked_sparse, lazy_sparse(spark, masked_sparse))):
        for name in ("sum", "mean", "var", "any", "all"):
            got = getattr(lazy, name)(axis=axis).to_numpy()
            want = getattr(np.ma if isinstance(local, np.ma.MaskedArray) else np, name)(local, axis=axis)
            if isinstance(local, np.ma.MaskedArray):
                want = np.ma.masked_array(want)
            same(got, np.asanyarray(want))


def test_reduction_details(spark):
    x = from_numpy(spark, X)
    same(x.var(axis=0, ddof=1).to_numpy(), X.var(axis=0, ddof=1))
    same(lazy_sparse(spark, S).var(axis=(0, 1), ddof=2).to_numpy(), S.var(axis=(0, 1), ddof=2))
    i = dense((4, 3), 6, dtype="int32")
    for name in ("sum", "mean", "var", "any", "all"):
        same(getattr(from_numpy(spark, i), name)(axis=0).to_numpy(), np.asanyarray(getattr(i, name)(axis=0)))
    same(from_numpy(spark, i).sum(axis=1, dtype="float32").to_numpy(), i.sum(axis=1, dtype="float32"))
    same(from_numpy(spark, i > 0).sum().to_numpy(), np.asarray((i > 0).sum()))
    u = np.array([200, 100, 255], np.uint8)
    same(from_numpy(spark, u).sum().to_numpy(), np.asarray(u.sum()))
    assert float(np.sum(x)) == pytest.approx(X.sum())
    same(np.mean(x, axis=1).to_numpy(), X.mean(axis=1))
    same(np.sum(x, 0).to_numpy(), X.sum(0))
    with pytest.raises(ValueError):
        x.sum(axis=3)


def test_all_counts_implicit_zeros(spark):
    s = np.zeros((3, 3))
    s[0], s[1, 1] = 2, -1
    lazy = lazy_sparse(spark, s)
    same(lazy.all(axis=1).to_numpy(), s.all(axis=1))
    assert not lazy.all().item() and lazy.any().item()


def test_reductions_of_what_fills_in(spark):
    lazy, local = np.exp(lazy_sparse(spark, S)) + 1, np.exp(S) + 1
    assert lazy.node.implicit and not is_sparse(lazy)
    same(lazy.sum(axis=1).to_numpy(), local.sum(axis=1))
    same(lazy.mean().to_numpy(), np.asarray(local.mean()))
    same(lazy.var(axis=(0, 2), ddof=1).to_numpy(), local.var(axis=(0, 2), ddof=1))
    assert "Range" not in lazy.sum(axis=1).to_df()._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.filterwarnings("ignore")
def test_empty_and_masked_groups(spark):
    e = from_numpy(spark, np.zeros((4, 0)))
    same(e.sum(axis=1).to_numpy(), np.zeros(4))
    same(e.mean(axis=1).to_numpy(), np.full(4, np.nan))
    same(e.var(axis=1).to_numpy(), np.full(4, np.nan))
    same(e.any(axis=1).to_numpy(), np.zeros(4, bool))
    same(e.all(axis=1).to_numpy(), np.ones(4, bool))
    for name in ("sum", "mean", "var", "any", "all"):
        assert np.ma.getmaskarray(getattr(from_numpy(spark, np.ma.masked_array([1], [True])), name)().to_numpy()).all()


def test_metadata(spark):
    x, m, s = from_numpy(spark, X), from_numpy(spark, M), lazy_sparse(spark, S)
    assert x.shape == np.shape(x) == X.shape and x.dtype == X.dtype and x.ndim == 3 and len(x) == 6
    assert x.seed is X and isinstance((x + 1).seed, tessera.WithArgs)
    assert is_pristine(x) and not is_pristine(x + 1) and is_pristine(X)
    assert is_masked(m) and not is_masked(x) and is_masked(m + x) and is_masked(M)
    assert is_sparse(s) and is_sparse(s * 2) and not is_sparse(s + 1) and is_sparse((s + 1) - 1)
    assert repr(s * 2) == "<6 x 5 x 4> sparse LazyArray object of type 'float64'"
    assert "..." not in repr(x) and "array(" in x.preview(1)
    node = (x - 2.0).node
    assert (node.operation, node.value, node.right, node.along) == ("subtract", 2.0, True, None)
    assert (2.0 - x).node.right is False
    assert np.round(x, 2).node.decimals == 2
    assert (x + np.ones(4)).node.along == 2
    assert tessera.wrap(x) is x and tessera.wrap(x.node).shape == x.shape
    same(np.array(x), X)
    same(np.array(x, dtype="int32"), X.astype("int32"))


def test_slices_reach_the_scan(spark, tmp_path):
    tessera.write_parquet(from_numpy(spark, X), str(tmp_path / "x"))
    table = spark.read.parquet(str(tmp_path / "x"))
    x = tessera.from_table(table, ["d0", "d1", "d2"], "v", X.shape, sparse=False)
    same((x * 2)[2:4].to_numpy(), X[2:4] * 2)
    plan = (x * 2)[2:4].to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d0,2)" in plan and "LessThanOrEqual(d0,3)" in plan


def test_absent_cells_are_written_out_behind_the_shuffle(spark, monkeypatch):
    masked = sparse((7, 5, 3), 8, 0.4)
    for run in (1, 4, 1 << 18):
        monkeypatch.setattr("tessera.plans.compile.RUN", run)
        for local, lazy in ((S, lazy_sparse(spark, S)), (masked, lazy_sparse(spark, masked))):
            got = (lazy + 2.5).to_df(dense=True).toPandas()
            want = np.ma.masked_array(local + 2.5)
            assert len(got) == local.size == len(got.drop_duplicates(["d0", "d1", "d2"]))
            at = want[got["d0"], got["d1"], got["d2"]]
            assert (np.ma.getmaskarray(at) == got["v"].isna().to_numpy()).all()
            np.testing.assert_allclose(got["v"].to_numpy()[~np.ma.getmaskarray(at)], at.compressed())
    outside = tessera.from_table(spark.createDataFrame([(0, 1, 5.0), (2, 0, 6.0), (0, -1, 7.0), (None, 0, 8.0)], "i long, j long, v double"), ["i", "j"], "v", (2, 2))
    assert sorted(map(tuple, outside.to_df(dense=True).collect())) == [(0, 0, 0.0), (0, 1, 5.0), (1, 0, 0.0), (1, 1, 0.0)]
    plan = lazy_sparse(spark, S).to_df(dense=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" in plan and plan.index("Generate") < plan.index("Exchange")


def test_validate_takes_more_tasks_for_larger_tables(spark, monkeypatch):
    from tessera import sources

    cells = spark.range(4000).selectExpr("id % 100 as i", "id div 100 as j", "1.0d as v")
    whole = cells.unionByName(spark.createDataFrame([(5, 5, 2.0), (5, 5, 2.0), (100, 0, 2.0), (None, 0, 2.0)], "i long, j long, v double"))
    table = tessera.from_table(whole, ["i", "j"], "v", (100, 40))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    tracker, asked = spark.sparkContext.statusTracker(), []
    for share in (1 << 40, 1 << 10):
        monkeypatch.setattr(sources, "SHARE", share)
        group = f"validate {share}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert tessera.validate(table) == {"outside": 2, "repeated": 1}
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        asked.append(max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)))
    assert asked[1] > 30 > asked[0]  # 32 KB of numbers and more
    assert {k: spark.conf.get(k) for k in before} == before
