import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from phyllo.operators.graph import components, group_digests

from .conftest import rows_of


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def edges_df(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@pytest.mark.parametrize("kind", ["empty", "chain", "star", "random", "nulls"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(1)
    ids = list(range(300))
    rng.shuffle(ids)
    edges = {
        "empty": [],
        "chain": list(zip(ids, ids[1:])),
        "star": [(150, i) for i in range(300)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)],
        "nulls": [(1, None), (None, 2), (3, 3), (5, 4), (4, 5), (4, 5), (5, 9)],
    }[kind]
    assert rows_of(components(spark, edges_df(spark, edges))) == sorted(union_find(edges), key=str)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_of_any_graph(spark, edges):
    assert rows_of(components(spark, edges_df(spark, edges))) == sorted(union_find(edges), key=str)


@pytest.mark.parametrize("piece", [1 << 20, 30])
@pytest.mark.parametrize("parts", [1, 7])
def test_group_digests_are_those_of_sorted_members(spark, parts, piece):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    members = [(r, f"s:{i * 7919 % 1000}é") for r in (1, 2, 3) for i in range(r * 50)]
    members += [(r, "t:alone") for r in range(10, 40)]
    try:
        got = dict(rows_of(group_digests(spark.createDataFrame(members, "root long, member string").repartition(5), "g_", piece)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert len(got) == 33
    for root in got:
        text = "\n".join(sorted(m for r, m in members if r == root))
        assert got[root] == "g_" + hashlib.sha256(text.encode()).hexdigest()[:16]
