import os

import pytest
from oracle import FOLDER, same

from postmill.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", list(Q.SQL))
def test_equals_sql(spark, name):
    same(spark, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.SQL])
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, FOLDER).count() > 0
