import os
import subprocess
import sys

import pytest

import __spark_entry__
from chronoframe.plans import catalogue
from tests.compare import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) and len(catalogue.QUERIES) > 60


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_agrees_with_its_sql(spark, name):
    assert spark_rows(catalogue.QUERIES[name](spark, SF)) == sql_rows(SF, catalogue.ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    os.mkdir(tmp_path / "chronoframe")
    for name in os.listdir(f"{root}/chronoframe"):
        if name != "llm":
            os.symlink(f"{root}/chronoframe/{name}", tmp_path / "chronoframe" / name)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline'] and len(q) > 60 and set(e.oracle_sql()) == set(q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
