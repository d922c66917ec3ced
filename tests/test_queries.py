"""Every registered query of the domain beside its SQL, on the smallest tables."""

import pytest
from compare import compare

import vesselspark.plans as plans
from __spark_entry__ import entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    if name in plans.ORACLES:
        compare(spark, name, plans.QUERIES[name], plans.ORACLES[name], SF)
    else:
        assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry(spark).collect()
    assert sum(r.n_findings for r in rows) == 8 and sum(r.n_moderate for r in rows) == 2
