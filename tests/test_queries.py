"""Every registered query against its SQL, run by another engine."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import SMALL
from oracle import compare, connect

from shelfsense.workload import oracle_texts, runners

RUN, SQL = runners(), oracle_texts()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, db, name):
    df = RUN[name](spark, SMALL)
    if name in SQL:
        assert compare(df, db, SQL[name]) == ""
    else:
        assert df.count() >= 0


def test_every_query_has_sql():
    assert set(SQL) == set(RUN)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """The library's own queries are listed where the training-data operators are absent."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for keep_pipeline in (True, False):
        copy = tmp_path / str(keep_pipeline)
        left_out = shutil.ignore_patterns("llm", ".git", "tests", *([] if keep_pipeline else ["corpus_pipeline.py"]))
        shutil.copytree(root, copy, ignore=left_out)
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
        assert said.stdout.split() == [str(len(RUN))] * 2
