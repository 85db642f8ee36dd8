"""Every registered query of the core against its SQL twin, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tidemark.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Queries of trained stacks: tests/test_stack_queries.py holds each against figures computed from rows.
STACK = {n for n in QUERIES if n[0] in "lk" and n not in ORACLES} | {"n03_slate_end_to_end", "n05_train_candidate"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)[:10] if isinstance(value, (datetime.date, datetime.datetime)) else str(value)
    return round(float(value), 5) + 0.0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in got.collect()) == expected


def test_every_query_has_sql_or_a_test_of_its_own():
    text = open(os.path.join(os.path.dirname(__file__), "test_stack_queries.py")).read()
    assert set(QUERIES) - set(ORACLES) == STACK and all(n in text for n in STACK)
