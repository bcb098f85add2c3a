"""Corpus queries that SQL can express, on the smallest given tables."""

import pytest

import compare
from tapeline.llm import queries
from tests.llm.cases import SF


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    rows, wrong = compare.difference(queries.queries()[name](spark, SF), queries.oracle_sql()[name], compare.connect(SF))
    assert rows and not wrong
