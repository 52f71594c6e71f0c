"""Every query of the core agrees with its SQL on the smallest tables."""

import pytest
from oracle import DATA, connect, rows_of_spark, rows_of_sql

from boscograph import catalogue


@pytest.fixture(scope="module")
def duck():
    return connect("sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees_with_sql(spark, duck, name):
    assert rows_of_spark(catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")) == rows_of_sql(duck, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, f"{DATA}/sf0.001").collect()


def test_nothing_but_the_entry_names_the_subpackage():
    from pathlib import Path

    root = Path(catalogue.__file__).parent
    for p in root.rglob("*.py"):
        if p.relative_to(root).parts[0] != "llm":
            assert "boscograph.llm" not in p.read_text(), p
