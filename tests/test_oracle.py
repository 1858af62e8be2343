"""Every registered query with an oracle gives the oracle's rows; the others run and keep their schema."""

import pytest
from conftest import SMALL
from harness import difference

from mnemoloom.plans.catalogue import CATALOGUE


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOGUE.items() if q.sql))
def test_matches_oracle(spark, oracle, name):
    assert difference(spark, oracle, CATALOGUE[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOGUE.items() if not q.sql))
def test_runs(spark, name):
    df = CATALOGUE[name].run(spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
