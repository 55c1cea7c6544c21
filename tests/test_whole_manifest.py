"""Queries over every row of the manifest, on small tables."""

import pytest

from phyllo import labels as L
from phyllo import queries as Q

from .conftest import rows_of

CLASSES = [f"{tree}_{condition}" for tree, conditions in L.TREE_CONDITIONS.items() for condition in conditions]
ROW = "item_id long, image_path string, source_dataset string, tree_type string, condition string, class_label string, group_id string, split string, written_at timestamp"


@pytest.fixture
def tables(spark, tmp_path):
    """Folder with a manifest of the given rows (item, path, class label, group, split), the labels and the items."""

    def make(*rows, source="s"):
        parts = {r.class_label: (r.tree_type, r.condition) for r in L.labels(spark).collect()}
        full = [(i, p, source, *parts.get(c, ("pear", "scab")), c, g, s, None) for i, p, c, g, s in rows]
        spark.createDataFrame(full, ROW).write.parquet(f"{tmp_path}/manifest.parquet")
        L.labels(spark).write.parquet(f"{tmp_path}/class_labels.parquet")
        spark.createDataFrame([("/1",), ("/2",)], "image_path string").write.parquet(f"{tmp_path}/items.parquet")
        return str(tmp_path)

    return make


def test_violations_of(spark, tables):
    d = tables((1, "/1", "apple_scab", " G1", "train"), (1, "/1", "apple_scab", "g1", "VAL"), (2, "/2", "apple_scab", "g2", "dev"), (None, "/3", "pear_scab", None, "Testing "))
    found = {r["constraint"]: r.violations for r in Q.manifest_violations(spark, d).collect()}
    assert found == {
        "split_known": 1, "class_known": 1, "label_parts": 0, "group_and_source": 1, "group_in_one_split": 1, "path_unique": 1, "splits_filled": 0, "labels_in_train": 17, "file_exists": 1,
    }


def test_missing_classes_and_unknown_labels_of(spark, tables):
    d = tables(
        (1, "/1", "apple_multiple_diseases", None, "train"), (1, "/1", "apple_multiple_diseases", None, "VAL"), (2, "/2", "cherry_healthy", "", "test"),
        (None, "/3", "pear_scab", "g", "train"), (3, "/3", "pear_scab", "g", None), (4, "/4", None, "g", "train"), (5, "/5", "orange_citrus_greening", "g", "test"),
    )
    found = rows_of(Q.missing_classes(spark, d), "scope", "class_label")
    seen = {"apple_multiple_diseases": {"train", "val"}, "cherry_healthy": {"test"}, "orange_citrus_greening": {"test"}}
    want = [("all", c) for c in CLASSES if c not in seen] + [(s, c) for c, there in seen.items() for s in {"train", "val", "test"} - there]
    assert found == sorted(want, key=str)
    assert rows_of(Q.unknown_labels(spark, d), "class_label", "n") == [("pear_scab", 2), (None, 1)]


def test_empty_splits_and_labels_without_training_of(spark, tables):
    d = tables((1, "/1", "apple_scab", "g", "VAL"), (1, "/1", "apple_scab", "g", "training"), (2, "/2", "cherry_healthy", None, "valid"), (None, "/3", "apple_healthy", "g", "train"), (4, "/4", "apple_healthy", "g", "dev"))
    assert rows_of(Q.empty_splits(spark, d)) == [("test",)]
    assert rows_of(Q.labels_without_training(spark, d)) == sorted([(c,) for c in CLASSES if c not in ("apple_scab", "apple_healthy")])
