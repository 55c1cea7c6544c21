import pytest

from phyllo import labels as L
from phyllo.operators import checks

from .conftest import rows_of

FIELDS = "image_path string, source_dataset string, tree_type string, condition string, class_label string, group_id string, split string"
GOOD = [("/1", "s", "apple", "scab", "apple_scab", "g1", "train"), ("/2", "s", "apple", "scab", "apple_scab", "g2", "val"), ("/3", "s", "apple", "scab", "apple_scab", "g3", "test")]


def counts(spark, rows, files=None):
    dim = L.labels(spark).where("class_label = 'apple_scab'")
    df = spark.createDataFrame(rows, FIELDS)
    return {r["constraint"]: r.violations for r in checks.manifest_violations(df, dim, spark, files).collect()}


def test_a_good_manifest_has_no_violations(spark):
    files = spark.createDataFrame([(r[0],) for r in GOOD], "image_path string")
    assert set(counts(spark, GOOD, files).values()) == {0}


@pytest.mark.parametrize(
    "broken, row",
    [
        ("split_known", ("/4", "s", "apple", "scab", "apple_scab", "g4", "dev")),
        ("split_known", ("/4", "s", "apple", "scab", "apple_scab", "g4", None)),
        ("class_known", ("/4", "s", "apple", "scab", "pear_scab", "g4", "train")),
        ("label_parts", ("/4", "s", "pear", "scab", "apple_scab", "g4", "train")),
        ("group_and_source", ("/4", "s", "apple", "scab", "apple_scab", "", "train")),
        ("group_and_source", ("/4", None, "apple", "scab", "apple_scab", "g4", "train")),
        ("group_in_one_split", ("/4", "s", "apple", "scab", "apple_scab", "g1", "test")),
        ("path_unique", ("/1", "s", "apple", "scab", "apple_scab", "g4", "train")),
    ],
)
def test_each_constraint_finds_its_violation(spark, broken, row):
    found = counts(spark, [*GOOD, row])
    assert found.pop(broken) == 1
    assert set(found.values()) == {0}


def test_empty_manifest(spark):
    found = counts(spark, [])
    assert found["splits_filled"] == 3 and found["labels_in_train"] == 1


def test_one_hot(spark):
    rows = [("Train_1", "1", "0"), ("Train_2", "1", "1"), ("Train_3", "0", "0.5"), ("x", "1", "0"), ("Train_4", "0", "1"), ("Train_4", "0", "1"), (None, "1", "0"), ("Train_5", None, "1")]
    df = spark.createDataFrame(rows, "image_id string, a string, b string")
    got = rows_of(checks.bad_one_hot(df, ["a", "b"]), "image_id", "problem")
    assert got == sorted([("Train_2", "not one-hot"), ("Train_3", "not one-hot"), ("Train_4", "repeated id"), ("Train_4", "repeated id"), ("Train_5", "not one-hot"), ("x", "unexpected id"), (None, "unexpected id")], key=str)


def test_label_table(spark):
    assert checks.bad_label_table(L.labels(spark)).count() == 0
    assert L.labels(spark).count() == 18 and L.label_map(spark).count() == 21
    odd = spark.createDataFrame([(0, "a", "t", "c"), (2, "b", "t", "c"), (3, "b", "t", "")], "label_index int, class_label string, tree_type string, condition string")
    assert checks.bad_label_table(odd).count() == 2
    again = L.reindex(L.labels(spark), spark.createDataFrame([("peach_healthy",), ("apple_scab",)], "class_label string"))
    assert rows_of(again, "label_index", "class_label") == [(0, "apple_scab"), (1, "peach_healthy")]


def test_inventory(spark):
    files = spark.createDataFrame([("r/A/1.jpg",), ("r/a/1.JPG",), ("r/../x.jpg",), ("/abs/A/1.jpg",), ("r/B/2.jpg",), ("short.jpg",)], "path string")
    cats = spark.createDataFrame([("A",), ("B",), ("C",)], "category string")
    got = {(r.problem, r.path): r.n for r in checks.bad_inventory(files, cats, 1).collect()}
    assert got["names differ only in case", "r/a/1.jpg"] == 2
    assert ("unsafe path", "r/../x.jpg") in got and ("unsafe path", "/abs/A/1.jpg") in got and ("unsafe path", "short.jpg") in got
    assert got["unknown category", "a"] == 1 and got["wrong number of files", "C"] == 0 and got["wrong number of files", "A"] == 2


def test_enforce_and_radius(spark):
    with pytest.raises(checks.ConstraintError, match="name: .*'x': 1"):
        checks.enforce("name", spark.sql("select 1 x"))
    checks.enforce("name", spark.sql("select 1 x where false"))
    for bad in (-1, 17, 2.5, True):
        with pytest.raises(ValueError):
            checks.check_radius(bad)


def test_cardinality_and_totals(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    found = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert rows_of(checks.not_exactly_one(wanted, found, "k"), "k", "matches") == [("b", 2), ("c", 0)]
    one, two = spark.sql("select 1L n"), spark.sql("select 2L n")
    assert checks.totals_disagree(a=one, b=one).count() == 0 and checks.totals_disagree(a=one, b=two).count() == 2
