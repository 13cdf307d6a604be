"""What the driver calls, and some queries against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = "pipeline_readme unary_log args_floor_divide_row args_divide_column_sums_sparse binary_add_sparse binary_equal_sparse subset_gather_dup combine_sparse reduce_var_sparse_filled reduce_mean_axis1_masked export_csr blocks_rows_sparse".split()


def rows(table):
    names = sorted(table.columns)
    clean = lambda x: None if x is None or x != x else float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x
    return sorted((tuple(clean(x) for x in r) for r in table[names].astype(object).itertuples(index=False)), key=str)


def test_only_the_absence_of_the_llm_parts_is_taken(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(entry.__file__).parent
    ask = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    copy = lambda name, *without: (shutil.copytree(here / "tessera", tmp_path / name / "tessera", ignore=shutil.ignore_patterns("__pycache__", *without)), shutil.copy(here / "__spark_entry__.py", tmp_path / name))
    run = lambda name: subprocess.run([sys.executable, "-c", ask], cwd=tmp_path / name, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    copy("bare", "llm")
    done = run("bare")
    assert done.returncode == 0 and done.stdout.split()[1] == "False", done.stderr
    copy("broken")
    (tmp_path / "broken" / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert run("broken").returncode != 0


def test_every_query_but_those_listed_has_sql():
    lacking = {n for n in entry.queries() if n not in entry.oracle_sql()}
    assert all(n == "pipeline" or n.startswith("op") for n in lacking)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_against_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    for name in SOME:
        got, want = rows(entry.queries()[name](spark, FOLDER).toPandas()), rows(c.execute(entry.oracle_sql()[name]).fetchdf())
        assert len(got) == len(want), name
        for a, b in zip(got, want):
            assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b)), (name, a, b)
    assert not entry.entry(spark).isEmpty()


WHOLE = "binary_equal_sparse binary_greater_equal_sparse binary_less_equal_sparse binary_power_sparse_dense unary_exp_sparse_dense combine_sparse_with_dense dense_sparse".split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_all_cells_are_there(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    n = c.execute("select (select max(p_partkey) + 1 from part) * (select max(s_suppkey) + 1 from supplier)").fetchone()[0]
    for name in WHOLE:
        got, want = rows(entry.queries()[name](spark, FOLDER).toPandas()), rows(c.execute(entry.oracle_sql()[name]).fetchdf())
        assert len(got) == len(want) == n * (1 + name.startswith("combine")), name
        for a, b in zip(got, want):
            assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b)), (name, a, b)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["export_csc", "export_csr"])
def test_a_compressed_row_of_several_parts_is_one_row_of_the_query(spark, name, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr("tessera.operators.export.PART", 3)
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{FOLDER}/lineitem.parquet'")
    got, want = rows(entry.queries()[name](spark, FOLDER).toPandas()), rows(c.execute(entry.oracle_sql()[name]).fetchdf())
    assert len(got) == len(want)
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=2e-6) for a, b in zip(got, want))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["pipeline_readme", "args_divide_column_sums_sparse"])
def test_columns_without_cells_have_no_rows(spark, name, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for table in ("part", "supplier", "lineitem"):
        c.execute(f"copy (select * from '{FOLDER}/{table}.parquet' {'where l_suppkey not in (2, 5)' if table == 'lineitem' else ''}) to '{tmp_path}/{table}.parquet'")
        c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    got, want = rows(entry.queries()[name](spark, str(tmp_path)).toPandas()), rows(c.execute(entry.oracle_sql()[name]).fetchdf())
    assert len(got) == len(want) > 0
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=2e-6) for a, b in zip(got, want))
