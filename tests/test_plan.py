"""The whole way from folders of pictures to a checked manifest."""

import csv
import json
import os

import numpy as np
import pytest

from phyllo import labels as L
from phyllo.__main__ import main
from phyllo.functions.images import encode_png
from phyllo.operators import checks
from phyllo.plans.prepare import prepare
from phyllo.sources import tables
from phyllo.sources.synthetic import make_sources

from .conftest import rows_of
from .test_sources import picture, put


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sources"))
    return root, make_sources(root, leaves=3)


def run(root, out, *more):
    return main(["prepare", "--folders", f"{root}/plantvillage", "--one-hot", f"{root}/cornell", "--ancestors", f"{root}/mangoleafbd", "--output", out, *more])


def read(spark, out):
    labels = tables.read_labels(spark, f"{out}/labels.json")
    return labels, tables.read_manifest(spark, f"{out}/manifest", labels)


def test_reviewed_collection(spark, sources, tmp_path):
    root, n = sources
    out = f"{tmp_path}/out"
    assert run(root, out, "--groups", f"{root}/groups.csv") == 0
    labels, manifest = read(spark, out)
    report = json.load(open(f"{out}/report.json"))
    assert labels.count() == 18 and manifest.count() == n == report["retained_images"] and report["unreadable_images"] == 1
    assert checks.groups_across_splits(manifest).count() == 0
    assert {r.split for r in manifest.where("source_dataset = 'mangoleafbd'").select("split").distinct().collect()} == {"train", "val", "test"}
    views = manifest.selectExpr("source_dataset", "regexp_replace(relative_path, '_[01].png', '') leaf", "group_id").where("source_dataset <> 'cornell'").distinct()
    assert views.count() == views.select("source_dataset", "leaf").distinct().count()
    with pytest.raises(SystemExit) as e:
        run(root, out)
    assert e.value.code == 2
    assert json.load(open(f"{out}/report.json")) == report


def test_curated_source_is_held_in_train_or_deduplicated(spark, sources, tmp_path):
    root, n = sources
    assert run(root, f"{tmp_path}/a") == 0
    _, manifest = read(spark, f"{tmp_path}/a")
    assert rows_of(manifest.where("source_dataset = 'mangoleafbd'").select("split").distinct()) == [("train",)]
    runs = []
    for k in "bc":
        assert run(root, f"{tmp_path}/{k}", "--curation", "deduplicate") == 0
        _, manifest = read(spark, f"{tmp_path}/{k}")
        runs.append(rows_of(manifest))
        assert manifest.where("source_dataset = 'mangoleafbd'").groupBy("group_id", "class_label").count().where("count > 1").count() == 0
    assert runs[0] == runs[1] and len(runs[0]) < n


def test_conflicts_stop_or_are_left_out(spark, make_items, tmp_path):
    items = make_items({"sha": "x", "label": "apple_scab"}, {"sha": "x", "label": "apple_healthy"}, *({"label": "apple_scab"} for _ in range(4)))
    with pytest.raises(checks.ConstraintError):
        prepare(spark, items, allow_partial=True, output=f"{tmp_path}/o")
    assert not os.path.exists(f"{tmp_path}/o/manifest") and os.path.exists(f"{tmp_path}/o/conflicts")
    done = prepare(spark, items, allow_partial=True, conflicts="exclude")
    assert done.manifest.count() == 4 and done.excluded.count() == 2 and done.report["excluded_conflicting_pixel_hashes"] == 1
    with pytest.raises(checks.ConstraintError):
        prepare(spark, items, conflicts="exclude")
    with pytest.raises(ValueError):
        prepare(spark, items.limit(0), allow_partial=True)


@pytest.mark.parametrize("more", [["--near-threshold", "17"], ["--groups", "/nowhere.csv"], ["--leaf-map", "/nowhere.json"]])
def test_preflight(sources, tmp_path, more):
    with pytest.raises(SystemExit) as e:
        run(sources[0], f"{tmp_path}/o", *more)
    assert e.value.code == 2 and not os.path.exists(f"{tmp_path}/o")


def test_partial_needs_leave(sources, tmp_path):
    with pytest.raises(SystemExit) as e:
        main(["prepare", "--one-hot", f"{sources[0]}/cornell", "--output", f"{tmp_path}/o"])
    assert e.value.code == 2
