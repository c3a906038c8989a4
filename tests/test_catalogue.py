"""Every query of the catalogue against its DuckDB SQL, and those without SQL for rows of a stable schema."""

import pytest
from compare import duck_rows, spark_rows

from docketspark import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, small, duck, name):
    assert spark_rows(plans.QUERIES[name](spark, small)) == duck_rows(duck.sql(plans.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_optional_parts():
    import subprocess
    import sys

    code = "import sys; sys.modules['docketspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'rrf_fusion' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
