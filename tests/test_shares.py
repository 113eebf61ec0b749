"""Pairs that share a value, beyond the size up to which pairs are made."""

from quillon.operators import joins


def test_no_link_is_lost(spark):
    rows = [(i, "x" if i < 300 else "y", str(i // 2)) for i in range(310)]
    got = joins.sharing_pairs(spark.createDataFrame(rows, "id long, big string, small string"), "id", ["big", "small"]).collect()
    large = [r for r in got if r.value == "x"]
    assert sorted((r.a, r.b, r.members) for r in large) == [(0, i, 300) for i in range(1, 300)]
    assert sum(r.value == "y" for r in got) == 45 and sum(r.kind == "small" for r in got) == 155
