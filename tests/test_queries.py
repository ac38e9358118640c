"""Every query against its SQL, and the entry."""

import pytest

from glimset.plans.oracles import ORACLES
from glimset.plans.queries import QUERIES
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
