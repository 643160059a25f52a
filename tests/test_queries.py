"""Every query with SQL gives what DuckDB gives."""

import pytest
from compare import expected, rows

from catweave.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, name):
    df = q.queries()[name](spark, SF)
    columns, want = expected(q.oracle_sql()[name], SF)
    assert sorted(df.columns) == columns
    norm = lambda xs: [x.replace(".0,", ",").replace(".0)", ")") for x in xs]  # noqa: E731  nullable integers come as floats
    assert norm(rows(df)) == norm(want)


def test_all_queries_have_sql():
    assert set(q.queries()) == set(q.oracle_sql())
