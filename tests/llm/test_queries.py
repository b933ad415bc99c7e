"""Queries with a statement, against DuckDB on whole tables."""

import pytest

import corpus_pipeline
from parity.check import connect, difference
from tillroll.llm.queries import STATEMENTS, registered


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_statement(spark, small, name):
    assert difference(registered()[name](spark, small), connect(small), STATEMENTS[name]) is None


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as driver

    names = driver.queries()
    assert {n.partition("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "bpe"]
