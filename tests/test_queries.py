"""Every core query that has SQL gives the same rows as its SQL."""

from __future__ import annotations

import pytest

from quarrylight import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, same_as_sql):
    same_as_sql(plans.queries()[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(plans.queries())
