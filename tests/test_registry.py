"""The registered queries run, and the core doesn't need the training-data package."""

import subprocess
import sys

import pytest

from tagloom import catalogue

SMALL = "/root/testdata/sf0.001"


def test_core_imports_nothing_of_the_training_package():
    code = "import sys, tagloom.catalogue; sys.exit(any(m.startswith('tagloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=catalogue.__file__.rsplit("/", 2)[0]).returncode == 0


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 200


@pytest.mark.parametrize("name", ["entry_search", "b31_soft_search", "d03_related_similarity", "j01_closure", "k12_anchors", "l01_snapshot_diff"])
def test_a_sample_of_queries_runs(spark, name):
    assert len(catalogue.QUERIES[name](spark, SMALL).columns) == len(set(catalogue.QUERIES[name](spark, SMALL).columns))
