import pytest

from chronoframe.llm import queries
from tests.compare import spark_rows, sql_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_agrees_with_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(SF, queries.ORACLES[name])


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
