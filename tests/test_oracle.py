"""Every registered query against its SQL twin on the smallest supplied tables."""

import os

import pytest

from tests.compare import check
from wirefold.workload import load

FOLDER = "/root/testdata/sf0.001"


# Compared with loops or made-up tables in the other test files, as SQL does not express them.
WITHOUT_SQL = {"firm_activity", "stemmed_search", "apply_added_answers"}


def test_only_known_queries_lack_sql():
    assert {name for name, q in load().items() if not q.sql} == WITHOUT_SQL


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are not here")
@pytest.mark.parametrize("name", [n for n in load() if n not in WITHOUT_SQL])
def test_query(spark, name):
    query = load()[name]
    diff, rows = check(spark, name, query.run, query.sql, FOLDER)
    assert diff is None
    assert rows > 0
