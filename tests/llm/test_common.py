from types import SimpleNamespace

import pyarrow as pa
import pytest

from tessera.llm import common


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: folder or default), sparkContext=SimpleNamespace(master=master))


def test_a_folder_of_the_machine_serves_local_mode_only():
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_root(session(master))
        assert common.shared_root(session(master, "hdfs://host/shared/")) == "hdfs://host/shared"
    assert common.shared_root(session("local[*]")) == common.shared_root(session("local"))


def test_free_names_are_free():
    df = SimpleNamespace(columns=["Key", "_key", "text"])
    assert common.free_name(df, "key") == "__key" and common.free_name(df, "found") == "found"


def test_runs_are_whole_and_pairs_complete():
    batches = [pa.record_batch({"key": pa.array(k, pa.int64())}) for k in ([1, 1, 2], [], [2, 2, 3], [3, 4])]
    tables = [t.column("key").to_pylist() for t in common.whole_runs(common.lean(iter)(batches), "key", 2)]
    assert tables == [[1, 1, 2, 2, 2], [3, 3, 4]]
    i, j = common.pairs_in_runs(common.run_bounds(pa.array([1, 1, 2, 2, 2, 3]).to_numpy()), 3)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 1), (2, 3), (2, 4), (3, 4)]


def test_staged_tables_hold_the_rows_and_restore_the_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    staged = common.stage(spark.range(100).groupBy("id").count(), "test")
    assert staged.count() == 100 and spark.conf.get(name) == before
    common.drop_staged(staged)
