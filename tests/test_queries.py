"""Every query with SQL against DuckDB on the smallest tables; every other one runs and gives rows."""

import subprocess
import sys
from pathlib import Path

import pytest
from check import connect, differences

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"tfidf_run_products", "encoder_run_metrics", "word_run_future", "graph_layout"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR).toPandas()
    assert len(got) > 0 or name == "unexpected_cached_labels"
    assert differences(got, duck.sql(contract.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql()) - SLOW))
def test_query_without_sql_gives_rows(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_worker_functions_travel_without_the_package(tmp_path):
    """Executors need no copy of the package: a query with Python workers runs from another folder."""
    root = Path(contract.__file__).resolve().parent
    script = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as c\nfrom pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"assert all(c.queries()[q](s, {SF_DIR!r}).count() > 0 for q in ('encoded_texts', 'labelled_documents'))\n"
    )
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, timeout=180)
