"""The registered queries: names, columns, and the DuckDB SQL where there is some."""

import os
import re
import sys

import pytest

from chainlens.llm.queries import ORACLE, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES] == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)["ok"] is True
