"""Every registered query against its SQL counterpart at the smallest scale."""

import pytest

from check_oracle import compare, connect
from swarmframe.queries import ALL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ALL))
def test_query(spark, con, name):
    query, sql = ALL[name]
    ok, note = compare(spark, con, query, sql, SF)
    assert ok, note


def test_known_counts(spark):
    """Counts of outcomes computed independently for this scale."""
    rows = ALL["sync_latest_outcomes"][0](spark, SF).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in rows} == {"displayed": 695, "superseded": 11, "late": 93}


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["session_id", "packet_id", "drone_id", "frame_num", "tick", "outcome"]
