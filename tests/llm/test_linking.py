import random

import pytest

from phyllo.llm import linking

from ..conftest import rows_of
from ..test_graph import edges_df, union_find

PAIRS = "item_id_a long, item_id_b long, image_path_a string, image_path_b string"


@pytest.mark.parametrize("kind", ["empty", "chain", "ordered chain", "star", "random", "nulls"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(2)
    ids = list(range(400))
    rng.shuffle(ids)
    edges = {
        "empty": [],
        "chain": list(zip(ids, ids[1:])),
        "ordered chain": [(i, i + 1) for i in range(400)],
        "star": [(399, i) for i in range(399)],
        "random": [(rng.randrange(500), rng.randrange(500)) for _ in range(330)],
        "nulls": [(1, None), (None, 2), (3, 3), (5, 4), (4, 5), (4, 5), (5, 9)],
    }[kind]
    assert rows_of(linking.components(spark, edges_df(spark, edges))) == sorted(union_find(edges), key=str)


def test_ends(spark, clash):
    items = spark.createDataFrame([(1, "/a"), (2, "/B "), (3, "/b"), (4, None), (5, "/c"), (5, "/c"), (None, "/z")], "item_id long, image_path string")
    pairs = [
        (1, 2, None, None), (2, 1, "", ""), (None, 3, "/a", None), (None, None, "/b", "/c"),
        (None, None, "/C", " /a"), (9, 1, None, None), (None, 1, "/gone", None), (None, 1, None, None), (None, 1, "/z", None), (1, 1, None, None), (1, None, None, "/a"), (4, 4, None, None),
    ]
    got = linking.resolve_ends(clash(spark.createDataFrame(pairs * 2, PAIRS)), clash(items))
    assert rows_of(got, "a", "b") == [(1, 2), (1, 3), (1, 5), (3, 5)]
    groups = linking.linked_groups(spark, spark.createDataFrame(pairs, PAIRS), items)
    assert rows_of(groups, "item_id", "group_item_id") == [(1, 1), (2, 1), (3, 1), (5, 1)]


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, image_path string")
    assert linking.linked_groups(spark, spark.createDataFrame([(1, 2, None, None)], PAIRS), items).count() == 0
    assert linking.linked_groups(spark, spark.createDataFrame([], PAIRS), items).count() == 0
