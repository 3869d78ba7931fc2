"""Every query of the core against its SQL on the smallest tables."""

import pytest
from compare import connect, differences
from conftest import SMALL

from ferrule.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, con, name):
    assert differences(catalog.QUERIES[name](spark, SMALL), con, catalog.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_every_query_runs_on_empty_tables(spark, tmp_path):
    from pathlib import Path

    for p in Path(SMALL).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(str(tmp_path / p.name))
    for name, f in catalog.QUERIES.items():
        if not name.startswith("stream_") and name not in ("stale_leases", "dlq_triage"):
            f(spark, str(tmp_path)).count()
