"""Every registered query against its SQL on the smallest tables."""

import importlib.util
import os

import pytest

from tests import oracle

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    cols, rows, types = oracle.spark_rows(entry.queries()[name](spark, FOLDER))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows, "a query without SQL must at least give rows"
        return
    want_cols, want, want_types = oracle.sql_rows(con, sql)
    assert cols == want_cols
    assert types == want_types
    assert rows == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
