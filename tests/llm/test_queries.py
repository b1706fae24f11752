import pytest

from coverlace.llm.queries import oracle_sql, queries
from tests import oracle

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.of_spark(queries()[name](spark, FOLDER)) == oracle.of_sql(oracle_sql()[name], FOLDER)
