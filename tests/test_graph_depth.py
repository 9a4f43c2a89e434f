"""Long chains and deep hierarchies, which the small tables do not hold."""

import pytest

from brindle.operators import graph


def test_a_long_chain_is_one_component(spark):
    # the two least ids at the ends: their labels meet last
    n = 102
    ids = [0, *range(2, n), 1]
    e = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (500, 500), (600, 601)], "src bigint, dst bigint")
    assert {r["id"]: r["component"] for r in graph.components(e).collect()} == {**dict.fromkeys(range(n), 0), 500: 500, 600: 600, 601: 600}


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "src bigint, dst bigint"), rounds=1)


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_a_path_goes_up_to_the_root(spark):
    t = spark.createDataFrame([(str(i), str(i + 1)) for i in range(19)] + [("19", None)], "community_id string, parent_id string")
    assert sorted(tuple(r) for r in graph.path_to_root(t, "0").collect()) == [(i, str(i)) for i in range(20)]
    assert graph.path_to_root(t, "0", 3).count() == 3
    assert graph.path_to_root(t, "x").count() == 0
