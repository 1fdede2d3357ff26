"""Every registered query against its SQL on the smallest scale; queries without SQL must give rows with a stable schema."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import compare, duck  # noqa: E402

from groupwise.plans import load  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", ["group_resample", "pareto_hull", "game_minimax_logistic", "adaptive_classifier", "boost_convergence"])
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == QUERIES[name](spark, SF).columns
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
