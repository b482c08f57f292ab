"""Every registered query of the library against its SQL, over the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as driver
from checks.compare import database, differences, type_differences
from checks.oracles import ORACLES
from checks.queries import REGISTRY

TABLES = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["from_no", "to_no", "weight", "prob"]
    assert result.count() == 8859


def test_queries_without_the_text_operators(tmp_path):
    """The driver's file lists the other queries when the text folders are gone."""
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py"))
    names = "import __spark_entry__ as d; print(*sorted(d.queries())); print(*sorted(d.oracle_sql()))"
    listed = subprocess.run(
        [sys.executable, "-c", names], cwd=tree, capture_output=True, text=True, check=True
    ).stdout.split("\n")
    assert listed[0].split() == sorted(REGISTRY)
    assert listed[1].split() == sorted(ORACLES)


@pytest.fixture(scope="module")
def connection():
    return database(TABLES)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, connection, name):
    got = REGISTRY[name](spark, TABLES)
    want = connection.sql(ORACLES[name])
    assert type_differences(got, want) == ""
    expected = want.df()
    assert len(expected) > 0
    assert differences(got.toPandas(), expected) == ""
