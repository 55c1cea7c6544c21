import csv
import io
import json
import zipfile

import pytest

from phyllo.__main__ import main
from phyllo.operators.checks import ConstraintError
from phyllo.sources import archives, tables

LABELS = ["healthy", "multiple_diseases", "rust", "scab"]


def one_hot(path, rows, pictures, more=()):
    text = io.StringIO()
    csv.writer(text).writerows([["image_id", *LABELS], *rows, ["", "", "", "", ""]])
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("r/train.csv", "\ufeff" + text.getvalue())
        z.writestr("r/test.csv", "image_id\nTest_0\n")
        for name in pictures:
            z.writestr(f"r/images/{name}", name)
        for name, data in more:
            z.writestr(name, data)
    return path


def test_one_hot_archive(spark, tmp_path):
    rows = [("Train_0", 0, 0, 1, 0), ("Train_1", 1, 0, 0, 0)]
    good = one_hot(f"{tmp_path}/a.zip", rows, ["Train_0.jpg", "Train_1.jpg", "Test_0.jpg"])
    receipt = archives.unpack_one_hot(spark, good, f"{tmp_path}/out", LABELS)
    assert receipt["per_label"] == {"healthy": 1, "multiple_diseases": 0, "rust": 1, "scab": 0} and receipt["n_files"] == 3 and receipt["ignored_pictures"] == 1
    assert receipt["tables"] == {"r/train.csv": 2, "r/test.csv": 1}
    assert json.load(open(f"{tmp_path}/out/receipt.json")) == receipt
    assert archives.unpack_one_hot(spark, good, f"{tmp_path}/out", LABELS) == receipt  # again: nothing is replaced


@pytest.mark.parametrize("rows, pictures", [
    ([("Train_0", 0, 0, 1, 0)], ["Train_0.jpg", "Train_1.jpg"]),
    ([("Train_0", 0, 0, 1, 0), ("Train_1", 1, 0, 0, 0)], ["Train_0.jpg"]),
    ([("Train_0", 0, 0, 1, 1)], ["Train_0.jpg"]),
    ([("Other_0", 0, 0, 1, 0)], ["Other_0.jpg"]),
])
def test_ids_and_pictures_must_agree(spark, tmp_path, rows, pictures):
    with pytest.raises(ConstraintError):
        archives.unpack_one_hot(spark, one_hot(f"{tmp_path}/a.zip", rows, pictures), f"{tmp_path}/out", LABELS)
    assert not (tmp_path / "out").exists()


def test_one_table_only(spark, tmp_path):
    path = one_hot(f"{tmp_path}/a.zip", [("Train_0", 0, 0, 1, 0)], ["Train_0.jpg"], [("q/train.csv", "image_id\n")])
    with pytest.raises(ValueError):
        archives.unpack_one_hot(spark, path, f"{tmp_path}/out", LABELS)


def test_category_archive(spark, tmp_path):
    path = f"{tmp_path}/m.zip"
    with zipfile.ZipFile(path, "w") as z:
        for c in ("A", "B"):
            for k in range(2):
                z.writestr(f"r/{c}/{k}.jpg", c)
    categories = spark.createDataFrame([("A",), ("B",)], "category string")
    assert archives.unpack_categories(spark, path, f"{tmp_path}/out", categories, 2)["per_category"] == {"A": 2, "B": 2}
    for wrong in (categories.limit(1), categories.union(spark.createDataFrame([("C",)], "category string"))):
        with pytest.raises(ConstraintError):
            archives.unpack_categories(spark, path, f"{tmp_path}/o2", wrong, 2)


def test_smoke(spark, tmp_path, capsys):
    assert main(["smoke", "--output", str(tmp_path)]) == 0
    said = capsys.readouterr().out
    assert "cornell" in said and "Train_0.png" in said
    config = json.load(open(f"{tmp_path}/run/run_config.json"))
    assert len(config["manifest_sha256"]) == 64 and json.load(open(f"{tmp_path}/run/metrics.json"))["accuracy"] > 0.5
    assert json.load(open(f"{tmp_path}/run/data_summary.json"))["train"]["images"] > 150


def test_relative_paths_lie_below_the_manifests_folder(spark, tmp_path):
    row = "{}, s, apple, scab, apple_scab, g{}, {}\n".replace(", ", ",")
    (tmp_path / "m.csv").write_text("image_path,source_dataset,tree_type,condition,class_label,group_id,split\n" + row.format("x/1.jpg", 1, "train") + row.format("/y/2.jpg", 2, "val") + row.format("s3://b/3.jpg", 3, "test"))
    from phyllo.labels import labels

    got = sorted(r.image_path for r in tables.read_manifest(spark, f"{tmp_path}/m.csv", labels(spark)).collect())
    assert got == sorted([f"{tmp_path}/x/1.jpg", "/y/2.jpg", "s3://b/3.jpg"])
