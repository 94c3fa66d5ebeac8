"""Every registered query of the library against its SQL in DuckDB."""

import os

import pytest

from tallyport.plans import registry

from . import verify


@pytest.fixture(scope="module")
def con(sf_dir):
    pytest.importorskip("duckdb")
    return verify.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    ok, _, said = verify.compare(spark, con, sf_dir, name, registry.queries()[name], registry.oracle_sql().get(name))
    assert ok, said


def test_fixture_counts(spark, sf_dir):
    """Row counts known beforehand for the comparison and the change log, of the tables ten times as large."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    if not os.path.isdir(sf):
        pytest.skip("no larger tables")
    assert {r["diff_type"]: r["n"] for r in registry.queries()["compare_summary"](spark, sf).collect()} == {"missing_target": 155, "missing_source": 149, "mismatch": 344}
    assert registry.queries()["changelog_latest_state"](spark, sf).count() == 122
    assert registry.queries()["changelog_upserts_first"](spark, sf).count() == 121


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
