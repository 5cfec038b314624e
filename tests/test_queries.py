"""Every registered query against its DuckDB twin, or at least that it runs."""

from __future__ import annotations

import pytest

from episodelake.plans import registered

REGISTERED = registered()


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query(spark, duck, sf, same, name):
    got = REGISTERED[name].build(spark, sf).toPandas()
    if REGISTERED[name].sql:
        same(got, duck.sql(REGISTERED[name].sql).df())
    else:
        assert len(got) > 0
