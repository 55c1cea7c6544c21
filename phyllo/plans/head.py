"""Training, evaluation and prediction by a linear head on fixed features of the pictures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import decode, small_grey
from ..operators import checks, metrics, split
from ..sources import images, tables
from . import evaluate

SIDE = 8


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Colour means and spreads and a small grey picture, between 0 and 1; null for unreadable files."""
    for batch in batches:
        rows = []
        for data in batch.column("content").to_pylist():
            try:
                rgb = decode(data or b"")
                flat = rgb.reshape(-1, 3) / 255
                rows.append(np.concatenate([flat.mean(0), flat.std(0), small_grey(rgb, SIDE).ravel() / 255]).tolist())
            except Exception:  # as for fingerprints: a broken file stops nothing
                rows.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("image_path"), pa.array(rows, pa.list_(pa.float64()))], names=["image_path", "values"])


def features(files: DataFrame) -> DataFrame:
    """``image_path`` and ``features`` of the readable files of ``image_path`` and ``content``."""
    from pyspark.ml.functions import array_to_vector

    done = files.select("image_path", "content").mapInArrow(feature_batches, "image_path string, values array<double>")
    return done.where("values IS NOT NULL").select("image_path", array_to_vector("values").alias("features"))


def pictures(spark: SparkSession, folders: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [images.find_images(spark, f, True).select("image_path", "content") for f in folders])


def train(spark: SparkSession, manifest: str, folders: list[str], output: str, rates: tuple = (0.0, 0.01, 0.1)) -> dict:
    """Fit on the train rows of a prepared manifest, select by validation, test once, and write the run.

    manifest: the output folder of ``prepare``. Written to ``output``, which
    must be new or empty: the model, the reports of the test rows,
    data_summary.json, preprocessing.json, run_config.json and history.json.
    """
    from ..session import Scratch

    tables.guard_output(spark, output)
    labels = tables.read_labels(spark, f"{manifest}/labels.json")
    rows = tables.read_manifest(spark, f"{manifest}/manifest", labels)
    checks.enforce("each split has rows", checks.empty_splits(rows, spark))
    checks.enforce("each label has training rows", checks.labels_without_rows(rows, labels, "train"))
    known = Scratch(spark, "head").save(rows.select("image_path", "source_dataset", "split", "group_id", "class_label", "target").join(features(pictures(spark, folders)), "image_path"))
    checks.enforce("every picture of the manifest can be read", rows.select("image_path").join(known, "image_path", "left_anti"))
    model, history = evaluate.fit_head(known.where("split = 'train'"), known.where("split = 'val'"), rates=rates)
    said = model.transform(known.where("split = 'test'")).select(F.col("target").cast("int").alias("target"), F.col("prediction").cast("int").alias("prediction"), "source_dataset")
    summary = evaluate.save_reports(spark, output, said, labels)
    model.write().overwrite().save(f"{output}/model")
    tables.write_json(spark, f"{output}/labels.json", tables.label_json(labels))
    tables.write_json(spark, f"{output}/data_summary.json", {r["split"]: r.asDict() for r in split.data_summary(rows, labels, spark).collect()})
    tables.write_json(spark, f"{output}/preprocessing.json", {"grey_side": SIDE, "colour": "mean and deviation of each channel", "upright": True})
    evaluate.write_run(spark, output, {"rates": list(rates), "best_epoch": metrics.best_epoch(history).first()["epoch"]}, f"{manifest}/manifest", history)
    return summary


def predict(spark: SparkSession, run: str, folders: list[str], top: int = 3) -> DataFrame:
    """The most likely labels of all pictures below the folders, by a trained run."""
    from pyspark.ml.classification import LogisticRegressionModel

    labels = tables.read_labels(spark, f"{run}/labels.json")
    said = evaluate.predict(LogisticRegressionModel.load(f"{run}/model"), features(pictures(spark, folders)), labels, top)
    return said.select("image_path", "rank", "class_label", "shown", "probability")
