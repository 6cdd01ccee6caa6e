"""Every registered query of the library runs, and matches its DuckDB SQL where it has one."""

import pytest
from oracle import differences, duck

from tidemark.plans.catalogue import FLAGSHIP, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert not differences(found, duck(sf_dir, ORACLES[name]))
    else:
        assert len(found) > 0 and len(found.columns) == len(set(found.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
