"""Every query that has an SQL text returns the same rows as DuckDB; the others run."""

from __future__ import annotations

from pathlib import Path

import pytest
from oracle import compare, connect

from tillwright.catalog import ENTRIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not present")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is not None])
def test_matches_sql(spark, duck, name):
    good, _, note = compare(spark, duck, name, ENTRIES[name], FOLDER)
    assert good, note


@pytest.mark.parametrize("name", ["explanation_prompts", "report_lines", "multivariate_anomalies_by_country"])
def test_runs(spark, name):
    assert ENTRIES[name].query(spark, FOLDER).count() > 0
