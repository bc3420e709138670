import pytest

from tests.compare import same_as_sql
from tidemark import plans
from tidemark.plans.registry import CASES


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    if name in plans.ORACLE_SQL:
        same_as_sql(df, duck, plans.ORACLE_SQL[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", list(CASES))
def test_literal_case_gives_the_rows_of_its_sql(spark, sf, duck, name):
    run, sql = CASES[name]
    same_as_sql(run(spark, sf), duck, sql)
