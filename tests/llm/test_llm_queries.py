import pytest
from oracle import DATA, connect, rows_of_spark, rows_of_sql

from boscograph.llm import queries

COLUMNS = {
    "p1_found": "extract_id line_no kind", "p2_found": "item_id label", "p3_found": "group_id keep category", "p4_found": "entity group_key", "p5_found": "item_a item_b", "p6_found": "concept_id term_id",
    "p7_found": "vec_id_a vec_id_b", "p8_found": "doc_id", "p9_found": "source", "p10_found": "doc_id",
}


@pytest.fixture(scope="module")
def duck():
    return connect("sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, duck, name):
    assert rows_of_spark(queries.QUERIES[name](spark, f"{DATA}/sf0.001")) == rows_of_sql(duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").collect() is not None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").columns == COLUMNS[name].split()
