"""Every query that SQL can express gives the rows of its SQL, on the smallest tables."""

import importlib

import pytest
from conftest import agrees

MODULES = ("domain", "counting", "quant", "graph", "mapping", "io")
CASES = [(m, n) for m in MODULES for n in importlib.import_module(f"seqloom.plans.{m}").ORACLE]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query_agrees_with_sql(spark, duck, data, module, name):
    m = importlib.import_module(f"seqloom.plans.{module}")
    agrees(spark, duck, data, m.QUERIES[name], m.ORACLE[name])


ROWS_ONLY = [(m, n) for m in MODULES for n in (lambda x: sorted(set(x.QUERIES) - set(x.ORACLE)))(importlib.import_module(f"seqloom.plans.{m}"))]


@pytest.mark.parametrize("module,name", ROWS_ONLY, ids=[n for _, n in ROWS_ONLY])
def test_query_without_sql_has_rows(spark, data, module, name):
    assert importlib.import_module(f"seqloom.plans.{module}").QUERIES[name](spark, data).count() > 0


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
