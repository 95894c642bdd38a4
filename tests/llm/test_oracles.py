"""Numbered queries against their SQL, and for rows where SQL cannot express them."""

import pytest

from gleaner.llm import queries as llm
from tests.oracle import check

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle_dir, name):
    check(spark, oracle_dir, llm.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_query_covers_its_table(spark, sf_dir, name):
    rows = llm.queries()[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
