import os

import pytest

from qanat.plans import catalog
from tests import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return compare.views()


#: What SQL can't state; held against brute force in test_audit.
NO_SQL = {"exact_group_split"}


def test_every_query_has_sql():
    assert set(catalog.queries()) - NO_SQL == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare.same(spark, con, catalog.queries()[name], catalog.oracle_sql()[name])


def test_plans_prune_and_stay_native(spark):
    """Scans read only what the query needs, and core queries run no Python."""
    plan = catalog.queries()["categorical_profile"](spark, compare.FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "messages" not in plan
    for name in ("near_duplicates", "gate_decisions", "conversation_decisions", "conversation_openings", "contract_issues", "eval_grouping_sets"):
        plan = catalog.queries()[name](spark, compare.FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
