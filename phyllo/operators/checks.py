"""Constraints. Each operator returns the rows that break one; none means that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .split import SPLITS


class ConstraintError(ValueError):
    """A constraint does not hold; the message has its name and some of the rows."""


def enforce(name: str, violations: DataFrame, show: int = 5) -> None:
    """Raise if there are violations."""
    rows = violations.limit(show).collect()
    if rows:
        raise ConstraintError(f"{name}: " + "; ".join(str(r.asDict()) for r in rows))


def unknown_splits(manifest: DataFrame) -> DataFrame:
    return manifest.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)))


def unknown_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select("class_label"), "class_label", "left_anti")


def label_parts_disagree(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose tree type or condition is not that of their label."""
    dim = labels.select("class_label", F.col("tree_type").alias("_tree"), F.col("condition").alias("_condition"))
    wrong = ~(F.col("tree_type").eqNullSafe(F.col("_tree")) & F.col("condition").eqNullSafe(F.col("_condition")))
    return rows.join(dim, "class_label").where(wrong).drop("_tree", "_condition")


def without_group_or_source(rows: DataFrame) -> DataFrame:
    empty = F.lit(False)
    for c in ("group_id", "source_dataset"):
        empty = empty | (F.coalesce(F.col(c), F.lit("")) == "")
    return rows.where(empty)


def groups_across_splits(rows: DataFrame) -> DataFrame:
    """Groups with rows in more than one split: leakage."""
    spread = rows.where("group_id IS NOT NULL AND group_id <> ''").groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count_distinct("split").alias("n_splits"))
    return spread.where("a <> b").select("group_id", "n_splits")


def missing_members(rows: DataFrame, known: DataFrame, key: str = "image_path") -> DataFrame:
    """Rows whose key is in no row of ``known`` (files, ids); a null key is missing too."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_exactly_one(wanted: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Keys of ``wanted`` that match no or several rows of ``found``, with the number of matches."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("matches"))
    return wanted.select(*keys).distinct().join(counts, list(keys), "left").fillna(0, ["matches"]).where("matches <> 1")


def set_differences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one of two tables has, with the side that has it in ``only_in``; none if the sets are equal."""
    a, b = (t.select(*keys).distinct() for t in (left, right))
    return a.join(b, list(keys), "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, list(keys), "left_anti").withColumn("only_in", F.lit("right")))


def empty_splits(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Splits without rows; all three if the table is empty."""
    wanted = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    return wanted.join(rows.select("split").distinct(), "split", "left_anti")


def labels_without_rows(rows: DataFrame, labels: DataFrame, split: str | None = None) -> DataFrame:
    """Labels without any row, or without any in the split."""
    rows = rows.where(F.col("split") == split) if split else rows
    return labels.select("class_label").join(rows.select("class_label").distinct(), "class_label", "left_anti")


def missing_classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per scope ("all" and each split) the labels without rows. A label missing everywhere is missing in "all" only."""
    observed = labels.join(rows.select("class_label").distinct(), "class_label", "left_semi")
    wanted = observed.select("class_label", F.explode(F.array(*map(F.lit, SPLITS))).alias("scope"))
    there = rows.select("class_label", F.col("split").alias("scope")).distinct()
    by_split = wanted.join(there, ["class_label", "scope"], "left_anti").select("scope", "class_label")
    return labels_without_rows(rows, labels).select(F.lit("all").alias("scope"), "class_label").unionByName(by_split)


def bad_one_hot(table: DataFrame, columns: list[str], id_col: str = "image_id", prefix: str = "Train_") -> DataFrame:
    """Rows of a one-hot label table that do not hold exactly one 1 and else 0, or whose id is strange or repeated."""
    values = [F.col(c).cast("double") for c in columns]
    binary = F.lit(True)
    for v in values:
        binary = binary & F.coalesce(v.isin(0.0, 1.0), F.lit(False))
    one = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)) == 1
    named = F.coalesce(F.col(id_col).startswith(prefix), F.lit(False))
    counted = table.withColumn("_n", F.count("*").over(Window.partitionBy(id_col)))
    problem = F.when(~named, "unexpected id").when(F.col("_n") > 1, "repeated id").when(~(binary & one), "not one-hot")
    return counted.withColumn("problem", problem).where("problem IS NOT NULL").drop("_n")


def bad_label_table(labels: DataFrame) -> DataFrame:
    """Rows of a label table with a gap in the index, a repeated label or an empty field. It is a dimension: one task."""
    at = F.row_number().over(Window.orderBy("label_index")) - 1
    times = F.count("*").over(Window.partitionBy("class_label"))
    empty = F.lit(False)
    for c in ("class_label", "tree_type", "condition"):
        empty = empty | (F.coalesce(F.col(c), F.lit("")) == "")
    return labels.withColumns({"_at": at, "_n": times}).where((F.col("_at") != F.col("label_index")) | F.col("label_index").isNull() | (F.col("_n") > 1) | empty).drop("_at", "_n")


def bad_inventory(files: DataFrame, categories: DataFrame, per_category: int | None = None, depth: int = 3) -> DataFrame:
    """Problems of an archive's inventory: unsafe or oddly deep paths, names equal but for case, wrong counts.

    files: ``path``; categories: ``category``, the folder before the file name.
    """
    parts = F.split("path", "/")
    unsafe = F.col("path").startswith("/") | F.array_contains(parts, "..") | F.col("path").contains("\\") | (F.size(parts) != depth)
    odd = files.where(F.coalesce(unsafe, F.lit(True))).select(F.lit("unsafe path").alias("problem"), "path", F.lit(1).cast("long").alias("n"))
    same = files.groupBy(F.lower("path").alias("path")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("names differ only in case").alias("problem"), "path", "n")
    out = odd.unionByName(same)
    folder = files.select(F.try_element_at(parts, F.lit(-2)).alias("category")).where("category IS NOT NULL")
    strange = folder.join(categories.select("category"), "category", "left_anti").groupBy(F.col("category").alias("path")).agg(F.count("*").alias("n"))
    out = out.unionByName(strange.select(F.lit("unknown category").alias("problem"), "path", "n"))
    if per_category is not None:
        counts = categories.select("category").distinct().join(folder.groupBy("category").agg(F.count("*").alias("n")), "category", "left").fillna(0, ["n"])
        out = out.unionByName(counts.where(F.col("n") != per_category).select(F.lit("wrong number of files").alias("problem"), F.col("category").alias("path"), "n"))
    return out


def bad_epochs(history: DataFrame) -> DataFrame:
    """Epochs that are repeated, out of 1..N or missing. A history is a small table: one task."""
    counted = history.groupBy("epoch").agg(F.count("*").alias("n"))
    last = history.agg(F.count("*").alias("rows"))
    wanted = last.where("rows > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("epoch"))
    joined = wanted.join(counted.select(F.col("epoch").cast("long").alias("epoch"), "n"), "epoch", "full")
    return joined.where("n IS NULL OR n <> 1").select("epoch", F.coalesce("n", F.lit(0)).alias("n")).unionByName(
        counted.join(last.withColumnRenamed("rows", "_r"), (F.col("epoch") < 1) | (F.col("epoch") > F.col("_r"))).select(F.col("epoch").cast("long").alias("epoch"), "n")
    ).distinct()


def bad_matrix(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells with a negative or missing count, or outside the labels."""
    known = labels.select(F.col("label_index").cast("long").alias("i"))
    cells = matrix.select(F.col("target").cast("long").alias("target"), F.col("prediction").cast("long").alias("prediction"), "n")
    inside = cells.join(known.withColumnRenamed("i", "target"), "target", "left_semi").join(known.withColumnRenamed("i", "prediction"), "prediction", "left_semi")
    return cells.where("n IS NULL OR n < 0").unionByName(cells.exceptAll(inside.select("target", "prediction", "n"))).distinct()


def totals_disagree(**totals: DataFrame) -> DataFrame:
    """Named one-row totals (column ``n``), all of them if they are not all equal."""
    rows = None
    for name, df in totals.items():
        part = df.select(F.lit(name).alias("total_of"), F.col("n").cast("long").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    bounds = rows.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("n").alias("known"), F.count("*").alias("all"))
    return rows.join(bounds.where("lo <> hi OR known <> all").select(F.lit(1).alias("_1")), F.lit(True)).drop("_1")


def support_disagrees(matrix: DataFrame, per_class: DataFrame) -> DataFrame:
    """Labels whose support is not the sum of their row in the matrix."""
    sums = matrix.groupBy(F.col("target").alias("label_index")).agg(F.sum("n").alias("row_sum"))
    joined = per_class.select("label_index", "support").join(sums, "label_index", "full")
    return joined.where(F.coalesce("support", F.lit(0)) != F.coalesce("row_sum", F.lit(0)))


def checkpoint_disagrees(history: DataFrame, checkpoint: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """The selected checkpoint (``epoch``, ``macro_f1``) if it is not the best epoch of the history."""
    from .metrics import best_epoch

    best = best_epoch(history).select(F.col("epoch").alias("best_epoch"), F.col("macro_f1").alias("best_f1"))
    wrong = ~F.col("epoch").eqNullSafe(F.col("best_epoch")) | (F.abs(F.col("macro_f1") - F.col("best_f1")) > tolerance) | F.isnan("macro_f1")
    return checkpoint.join(best, F.lit(True)).where(F.coalesce(wrong, F.lit(True)))


def check_radius(radius: int) -> int:
    if not isinstance(radius, int) or isinstance(radius, bool) or not 0 <= radius <= 16:
        raise ValueError("the near threshold must be a whole number from 0 to 16")
    return radius


def manifest_violations(manifest: DataFrame, labels: DataFrame, spark: SparkSession, files: DataFrame | None = None) -> DataFrame:
    """Number of violations of every constraint on a manifest, zeros included."""
    checks = {
        "split_known": unknown_splits(manifest),
        "class_known": unknown_labels(manifest, labels),
        "label_parts": label_parts_disagree(manifest, labels),
        "group_and_source": without_group_or_source(manifest),
        "group_in_one_split": groups_across_splits(manifest),
        "path_unique": repeated(manifest, "image_path"),
        "splits_filled": empty_splits(manifest, spark),
        "labels_in_train": labels_without_rows(manifest, labels, "train"),
    }
    if files is not None:
        checks["file_exists"] = missing_members(manifest, files)
    out = None
    for name, rows in checks.items():
        part = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint"), "violations")
        out = part if out is None else out.unionByName(part)
    return out
