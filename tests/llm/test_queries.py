import os

import pytest

from qanat.llm import queries
from tests import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare.same(spark, compare.views(), queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    df = queries.queries()[name](spark, compare.FOLDER)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
