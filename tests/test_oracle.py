import os

import pytest
from oracle import FOLDER, same

from postmill.queries import data, postings, state

CASES = [(n, m) for m in (data, postings, state) for n in m.SQL]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize(("name", "module"), CASES, ids=[n for n, _ in CASES])
def test_equals_sql(spark, name, module):
    same(spark, module.QUERIES[name], module.SQL[name])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", [n for m in (data, postings, state) for n in m.QUERIES if n not in m.SQL])
def test_runs_without_sql(spark, name):
    module = next(m for m in (data, postings, state) if name in m.QUERIES)
    assert module.QUERIES[name](spark, FOLDER).count() > 0
