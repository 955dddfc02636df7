"""Every registered query of the library's own operators against DuckDB, on the smallest tables."""

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from logforge.functions import lineage
from logforge.jobs import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else str(v) if isinstance(v, (pd.Timestamp, str)) else float(v))
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_sql(spark, name):
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        want = _plain(db.sql(SQL[name]).df())
    got = _plain(catalog.queries()[name](spark, DATA).toPandas())
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_registration():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_without_the_training_operators(tmp_path):
    """A copy without logforge/llm, its tests and whatever else stands on them still registers every other query."""
    root = pathlib.Path(__file__).parents[1]
    ignored = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "spark-warehouse")
    for with_pipeline in (True, False):
        copy = tmp_path / str(with_pipeline)
        shutil.copytree(root, copy, ignore=ignored)
        if not with_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e, bench; print(len(e.queries()), len(e.oracle_sql())); assert not any(q.startswith('op1') or q == 'pipeline' for q in e.queries())"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert done.stdout.split() == [str(len(catalog.queries())), str(len(SQL))]


def test_scratch_folder_is_shared():
    class Session:
        class conf:
            get = staticmethod(lambda key, other: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.scratch_dir(Session)
