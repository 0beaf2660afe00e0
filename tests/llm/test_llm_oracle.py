import pytest
from conftest import agrees

from seqloom.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_query_agrees_with_sql(spark, duck, data, name):
    agrees(spark, duck, data, Q.QUERIES[name], Q.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_without_sql_has_rows(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() > 0


def test_no_other_module_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(Q.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
