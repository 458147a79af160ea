import pytest
from compare import duck, rows_of, sql_rows

from vahini.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == sql_rows(duck(small), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() == df.distinct().count()
