"""Every SQL-expressible registered query against its DuckDB twin (sf0.001)."""

import pytest

from loanbook.plans import catalog

catalog.load_all()
NAMES = sorted(catalog.ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, name):
    from loanbook.testing import compare
    res = compare(catalog.QUERIES[name](spark, sf_small), catalog.ORACLE[name], sf_small)
    assert res["ok"], res


def test_profiles_without_a_twin_hold_their_ranges(spark, sf_small):
    lgd = catalog.QUERIES["m14_lgd"](spark, sf_small).selectExpr("min(lgd)", "max(lgd)", "count(*)", "count(DISTINCT id)").first()
    assert 0 <= lgd[0] <= lgd[1] <= 1 and lgd[2] == lgd[3] > 0
    t = catalog.QUERIES["q8_totals"](spark, sf_small).first()
    assert t.profit <= t.dual_bound and t.gap >= 0 and t.granted > 0
    assert t.rwa <= t.rwa_limit + 1e-3 and t.el <= t.provision_limit + 1e-3 and t.ead <= t.cash_limit + 1e-3


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
