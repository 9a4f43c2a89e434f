"""Rounds of merges and moves do not send their tables through the driver."""

import pytest

from brindle import shared
from brindle.operators import modularity
from tests.test_modularity import cliques


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that are written."""
    found, table = [], shared.Written.table

    def seen(self, df, name):
        found.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return table(self, df, name)

    monkeypatch.setattr(shared.Written, "table", seen)
    return found


def test_joins_of_rounds_do_not_broadcast_tables(spark, monkeypatch, plans):
    monkeypatch.setattr(modularity, "SMALL", 1, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    d = spark.createDataFrame(cliques(3, 4), "src bigint, dst bigint, weight double")
    out, _ = modularity.communities(d, (1.0,), refine=1)
    assert any("Join" in p for _, p in plans)
    assert [n for n, p in plans if "Broadcast" in p] == []
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert len({r.community_id for r in out.collect()}) == 3


def test_broadcasts_that_are_off_stay_off(spark):
    with shared.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), shared.small_broadcasts(spark, 1000):
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    with shared.small_broadcasts(spark, 1000):
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "1000"
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "1000"
