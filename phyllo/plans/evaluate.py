"""Evaluation reports, a model on fixed features, and the summary of a training run."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display_name
from ..operators import checks, metrics
from ..sources import tables


def evaluate(predictions: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Confusion, per-class and summary tables, overall and by source.

    predictions: ``target``, ``prediction`` and, if wanted, ``source_dataset``.
    """
    matrix = metrics.confusion(predictions)
    per_class = metrics.per_class_metrics(metrics.class_marginals(matrix, labels))
    out = {"confusion": matrix, "per_class": per_class.join(labels, "label_index"), "summary": metrics.summary_metrics(per_class)}
    if "source_dataset" in predictions.columns:
        by = metrics.class_marginals(metrics.confusion(predictions, "source_dataset"), labels, "source_dataset")
        out["by_source"] = metrics.summary_metrics(metrics.per_class_metrics(by), "source_dataset")
    return out


def save_reports(spark: SparkSession, output: str, predictions: DataFrame, labels: DataFrame) -> dict:
    """metrics.json, per_class and confusion_matrix in a new or empty folder."""
    tables.guard_output(spark, output)
    done = evaluate(predictions, labels)
    summary = done["summary"].first().asDict()
    summary["missing_classes"] = [r["class_label"] for r in done["per_class"].where("support = 0").orderBy("label_index").collect()]
    if "by_source" in done:
        summary["by_source"] = {r["source_dataset"]: r.asDict() for r in done["by_source"].collect()}
    tables.write_csv(done["per_class"], f"{output}/per_class", ("label_index", "class_label", "tree_type", "condition", "support", "precision", "recall", "f1"), ("label_index",), single=True)
    wide = metrics.confusion_wide(done["confusion"], labels)
    wide.coalesce(1).write.csv(f"{output}/confusion_matrix", header=True)
    tables.write_json(spark, f"{output}/metrics.json", summary)
    return summary


def fit_head(train: DataFrame, validation: DataFrame, features: str = "features", label: str = "target", rates: tuple = (0.0, 0.01, 0.1)):
    """A multinomial logistic regression on fixed features; the best of the regularisations by validation macro F1.

    Returns the model and the history, one row per candidate (``epoch``, ``learning_rate``, ``macro_f1``).
    """
    from pyspark.ml.classification import LogisticRegression

    spark = train.sparkSession
    labels = train.select(F.col(label).cast("int").alias("label_index")).distinct()
    history, models = [], []
    for k, rate in enumerate(rates, 1):
        model = LogisticRegression(featuresCol=features, labelCol=label, regParam=rate, maxIter=50, family="multinomial").fit(train)
        said = model.transform(validation).select(F.col(label).cast("int").alias("target"), F.col("prediction").cast("int").alias("prediction"))
        f1 = metrics.summary_metrics(metrics.per_class_metrics(metrics.class_marginals(metrics.confusion(said), labels))).first()["macro_f1"]
        history.append((k, float(rate), float(f1)))
        models.append(model)
    table = spark.createDataFrame(history, "epoch int, learning_rate double, macro_f1 double")
    return models[metrics.best_epoch(table).first()["epoch"] - 1], table


def predict(model, rows: DataFrame, labels: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` most likely labels of each row with their probabilities and shown names."""
    from pyspark.ml.functions import vector_to_array

    p = model.transform(rows).withColumn("_p", F.transform(vector_to_array("probability"), lambda x, i: F.struct(i.alias("i"), x.alias("p"))))
    best = F.slice(F.array_sort("_p", lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(a["i"] - b["i"])), 1, top)
    out = p.select(*rows.columns, F.posexplode(best).alias("rank", "b")).select(*rows.columns, "rank", F.col("b.i").alias("label_index"), F.col("b.p").alias("probability"))
    return out.join(labels.select("label_index", "class_label", display_name("class_label").alias("shown")), "label_index", "left")


def write_run(spark: SparkSession, output: str, config: dict, manifest: str, history: DataFrame) -> dict:
    """run_config.json with one SHA-256 of the manifest and those of its files, and history.json.

    A manifest of one file has that file's digest; one of several files has the
    digest of their digests, one a line, in the order of their names.
    """
    files = spark.read.format("binaryFile").load(manifest).where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]"))
    hashes = [r["h"] for r in files.select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()]  # one row per file of the manifest
    whole = hashes[0] if len(hashes) == 1 else hashlib.sha256("\n".join(hashes).encode()).hexdigest()
    record = {**config, "manifest_sha256": whole, "manifest_files": hashes}
    tables.write_json(spark, f"{output}/run_config.json", record)
    tables.write_json(spark, f"{output}/history.json", [r.asDict(True) for r in history.orderBy("epoch").collect()])
    return record


def read_run(spark: SparkSession, output: str) -> dict:
    """What ``save_reports`` and ``write_run`` wrote; a missing part is an error."""
    def parsed(name: str):
        import json

        return json.loads(spark.read.text(f"{output}/{name}", wholetext=True).first()[0])

    per_class = spark.read.csv(f"{output}/per_class", header=True, schema="label_index int, class_label string, tree_type string, condition string, support long, precision double, recall double, f1 double")
    wide = spark.read.csv(f"{output}/confusion_matrix", header=True)
    names = [r["class_label"] for r in per_class.orderBy("label_index").collect()]  # a dimension
    if wide.columns != ["true / predicted", *names]:
        raise ValueError("the columns of the confusion matrix are not the labels in their order")
    index = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("prediction"), F.col(f"`{n}`").cast("long").alias("n")) for i, n in enumerate(names))))
    matrix = wide.select(F.element_at(index, F.col("true / predicted")).alias("target"), cells.alias("c")).select("target", "c.*")
    return {"metrics": parsed("metrics.json"), "config": parsed("run_config.json"), "history": spark.createDataFrame(parsed("history.json")), "per_class": per_class, "confusion": matrix}


def check_run(history: DataFrame, matrix: DataFrame, per_class: DataFrame, labels: DataFrame, checkpoint: DataFrame, summary_n: int) -> None:
    """All agreements between the artefacts of a training run."""
    checks.enforce("epochs count from 1", checks.bad_epochs(history))
    checks.enforce("matrix cells", checks.bad_matrix(matrix, labels))
    total = matrix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    said = history.sparkSession.createDataFrame([(summary_n,)], "n long")
    checks.enforce("totals", checks.totals_disagree(matrix=total, metrics=said, per_class=per_class.agg(F.coalesce(F.sum("support"), F.lit(0)).alias("n"))))
    checks.enforce("row sums are supports", checks.support_disagrees(matrix, per_class))
    checks.enforce("checkpoint is the best epoch", checks.checkpoint_disagrees(history, checkpoint))


def markdown(summary: dict, history: list[dict], errors: list[dict], names: dict[int, str]) -> str:
    """A report for people, from small aggregates."""
    def pct(x: float) -> str:
        return f"{100 * x:.2f}%" if x is not None and math.isfinite(x) else "-"

    lines = ["# Training run", "", f"- images: {summary['n']:,}", f"- accuracy: {pct(summary['accuracy'])}", f"- macro F1: {summary['macro_f1']:.4f}", "", "| epoch | macro F1 |", "|---|---|"]
    lines += [f"| {h['epoch']} | {h['macro_f1']:.4f} |" for h in history]
    lines += ["", "| true | predicted | images |", "|---|---|---|"]
    lines += [f"| {names[e['target']]} | {names[e['prediction']]} | {e['n']} |" for e in errors]
    return "\n".join(lines) + "\n"
