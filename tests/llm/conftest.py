import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import odd  # noqa: E402


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """Tables with nulls, empty and very long texts, ties, repeated rows and
    columns whose names the operators use themselves."""
    return odd.write(spark, str(tmp_path_factory.mktemp("odd")))


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    return odd.write(spark, str(tmp_path_factory.mktemp("empty")), rows=False)
