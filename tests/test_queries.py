"""Every registered core query against its DuckDB twin."""

import pytest
from conftest import same_rows

from pagelake import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_twin(spark, sf_dir, duck, name):
    frame = core.QUERIES[name](spark, sf_dir)
    assert same_rows(frame, duck.sql(core.ORACLE_SQL[name]))


def test_not_empty(spark, sf_dir):
    assert core.QUERIES["dehyphenate_pairs"](spark, sf_dir).count() > 100
    assert core.QUERIES["merge_adjacent"](spark, sf_dir).where("size(members) > 1").count() > 0
    assert core.QUERIES["overlap_pairs"](spark, sf_dir).groupBy("victim").count().count() == 3


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_exchange_cleans_text(spark, sf_dir):
    plan = core.QUERIES["clean_text"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan
