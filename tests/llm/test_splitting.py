import random

import pytest
from pyspark.sql import functions as F

from phyllo.llm import splitting

from ..conftest import rows_of
from ..test_graph import edges_df, union_find

MANIFEST = "item_id long, image_path string, source_dataset string, group_id string, split string"


@pytest.mark.parametrize("seed", range(3))
def test_hash_to_min_equals_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(None, 1), (7, 7)]
    assert rows_of(splitting.hash_to_min(spark, edges_df(spark, edges))) == sorted(union_find(edges), key=str)
    assert splitting.hash_to_min(spark, edges_df(spark, [])).count() == 0


def test_broken_groups(spark, clash):
    rows = [
        (1, "/1", "s", "G1 ", "train"), (2, "/2", "s", "g1", "TRAINING"), (3, "/3", "s", "g2", "train"), (4, "/4", "s", " G2", "val "), (5, "/5", "s", "g3", "test"), (5, "/5", "s", "g3", "train"),
        (6, "/6", "s", "g4", None), (7, "/7", "s", "g4", "val"), (8, "/8", "s", None, "val"), (8, "/8", "s", None, "train"), (9, "/9", "s", "g5", "odd"), (10, "/10", "s", "g5", "val"), (None, None, None, None, None),
    ]
    assert rows_of(splitting.broken_groups(spark, clash(spark.createDataFrame(rows * 2, MANIFEST))), "group_id") == [("g2",), ("g3",)]
    assert splitting.broken_groups(spark, spark.createDataFrame([], MANIFEST)).count() == 0


def manifest(spark, n=6000):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        source = "big" if i % 5 else "small"
        group = "hot" if i % 3 == 0 and source == "big" else f"g{i // 2}" if i % 7 else None
        rows.append((i, f"/{i}", source, group, rng.choice(["train", "val", None])))
    rows += [(10, "/10", "big", "g9999", "train")]
    return spark.createDataFrame(rows, MANIFEST)


def test_assignment(spark):
    m = manifest(spark)
    done = splitting.assign(spark, m)
    assert done.agg(F.sum("n")).first()[0] == m.count()
    assert done.groupBy("component").agg(F.count_distinct("new_split").alias("k")).where("k > 1").count() == 0
    assert done.groupBy("entity").agg(F.count_distinct("component").alias("k")).where("k > 1").count() == 0
    for r in splitting.balance(done).collect():
        assert abs(r.share - {"train": 0.8, "val": 0.1, "test": 0.1}[r.new_split]) < 0.01, r
    again = splitting.assign(spark, m.repartition(7))
    assert rows_of(done, "entity", "new_split") == rows_of(again, "entity", "new_split")
    # The item with rows in two groups holds these together.
    both = {r.component for r in done.where("entity IN ('group:g5', 'group:g9999')").collect()}
    assert len(both) == 1


def test_nothing_to_assign(spark):
    assert splitting.assign(spark, spark.createDataFrame([], MANIFEST)).count() == 0
