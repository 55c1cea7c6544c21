"""Importers of the three kinds of source, and enrichment of their rows with groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import checks
from .images import find_images

ROW = ("image_path", "relative_path", "source_dataset", "class_label", "official_group", "reviewed_group")


def _rows(df: DataFrame, source: str) -> DataFrame:
    given = {"official_group": F.lit("")} if "official_group" not in df.columns else {}
    return df.withColumns({"source_dataset": F.lit(source), "reviewed_group": F.lit(""), **given}).select(*ROW)


def leaf_groups(images: DataFrame, leaf_map: DataFrame) -> DataFrame:
    """``images`` with ``found_group``: the group that the leaf map has for the photo, '' if none or several.

    images: ``image_path`` and ``folder``; leaf_map: ``photo_id`` and
    ``groups`` (array). A single entry counts as it is; of several, those that
    name the folder, if they are all the same.
    """
    looked_up = images.withColumn("photo_id", X.photo_id("image_path")).join(leaf_map, "photo_id", "left")
    fitting = F.array_distinct(F.when(F.size("groups") == 1, F.col("groups")).otherwise(F.filter("groups", lambda g: F.contains(g, F.col("folder")))))
    return looked_up.withColumn("found_group", F.coalesce(F.when(F.size(fitting) == 1, F.element_at(fitting, 1)), F.lit(""))).drop("groups", "photo_id")


def read_leaf_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object from photo id to a group or a list of groups, as ``photo_id`` and ``groups``."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("photo_id", "raw"))
    listed = F.from_json("raw", "array<string>")
    return pairs.select("photo_id", F.when(F.col("raw").startswith("["), listed).otherwise(F.array("raw")).alias("groups"))


def picture_root(folder: str, known: list[str]) -> str:
    """The folder that holds one folder per label: ``raw/color`` or ``color`` below the given one, or itself.

    The first that exists and has a known label folder counts; grey or
    segmented variants of the pictures are refused. For folders that the driver sees.
    """
    import os

    for place in (os.path.join(folder, "raw", "color"), os.path.join(folder, "color"), folder):
        if any(os.path.isdir(os.path.join(place, name)) for name in known):
            if {p.lower() for p in os.path.abspath(place).split(os.sep)} & {"grayscale", "segmented"}:
                break
            return place
    raise ValueError(f"{folder} does not hold the original colour pictures")


def csv_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Columns and number of nonempty data rows of each CSV file below a folder: ``path``, ``header``, ``n_rows``."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(folder, wholetext=True)
    lines = F.filter(F.split(F.replace("value", F.lit("\ufeff"), F.lit("")), r"\r?\n"), lambda x: F.length(F.trim(F.replace(x, F.lit(","), F.lit("")))) > 0)
    got = text.select(F.regexp_replace(F.input_file_name(), "^file:/*", "/").alias("path"), lines.alias("lines"))
    return got.select("path", F.coalesce(F.get("lines", F.lit(0)), F.lit("")).alias("header"), F.greatest(F.size("lines") - 1, F.lit(0)).alias("n_rows"))


def import_folders(spark: SparkSession, root: str, mapping: DataFrame, source: str, leaf_map: DataFrame | None = None) -> DataFrame:
    """A source with one folder per label directly below ``root``; other folders are not read.

    With a leaf map the official group of each picture is looked up.
    """
    names = mapping.where(F.col("source_dataset") == source).select(F.col("source_label").alias("folder"), "class_label")
    images = find_images(spark, root).withColumn("folder", F.element_at(F.split("relative_path", "/"), 1)).join(names, "folder")
    if leaf_map is not None:
        images = leaf_groups(images, leaf_map).withColumnRenamed("found_group", "official_group")
    return _rows(images, source)


def import_ancestors(spark: SparkSession, root: str, mapping: DataFrame, source: str) -> DataFrame:
    """A source whose label is the name of some folder above the picture; none or two labels are errors."""
    names = mapping.where(F.col("source_dataset") == source).select(X.normalize_name("source_label").alias("key"), "class_label")
    images = find_images(spark, root)
    parts = F.split("relative_path", "/")
    above = images.select("image_path", F.explode(F.concat(F.array(F.lit(root.rstrip("/").rsplit("/", 1)[-1])), F.slice(parts, 1, F.size(parts) - 1))).alias("part"))
    found = above.withColumn("key", X.normalize_name("part")).join(names, "key").groupBy("image_path").agg(F.min("class_label").alias("class_label"), F.count_distinct("class_label").alias("n"))
    labelled = images.join(found, "image_path", "left")
    checks.enforce("each picture lies below the folder of exactly one label", labelled.where("n IS NULL OR n <> 1").select("image_path", "n"))
    return _rows(labelled, source)


def import_one_hot(spark: SparkSession, root: str, mapping: DataFrame, source: str, table: str = "train.csv", prefix: str = "Train_") -> DataFrame:
    """A source with a one-hot label table beside its pictures. Each id must have exactly one picture;
    pictures without a row, as those of a test set, are not used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", table).load(root).select("path").limit(2).collect()
    if len(files) != 1:
        raise ValueError(f"expected exactly one {table} below {root}, found {'more' if files else 'none'}")
    place = files[0]["path"]
    folder = place.rsplit("/", 1)[0].replace("file:", "", 1)
    labels = spark.read.csv(place, header=True)
    names = {r["source_label"]: r["class_label"] for r in mapping.where(F.col("source_dataset") == source).collect()}  # a dimension
    missing = sorted({"image_id", *names} - set(labels.columns))
    if missing:
        raise ValueError(f"{table} lacks columns {missing}")
    checks.enforce("one-hot labels", checks.bad_one_hot(labels, list(names), prefix=prefix))
    images = find_images(spark, folder).withColumn("image_id", X.stem("image_path"))
    checks.enforce("one picture per id", checks.not_exactly_one(labels, images, "image_id"))
    chosen = F.coalesce(*(F.when(F.col(c).cast("double") == 1, F.lit(v)) for c, v in names.items()))
    return _rows(images.join(labels.select("image_id", chosen.alias("class_label")), "image_id"), source)


def match_reviewed(items: DataFrame, review: DataFrame) -> DataFrame:
    """Each record of a review with the item that it names and what is wrong with it.

    review: ``source_dataset``, ``image_path`` and ``group_id``. The path may be
    an item's path, relative path, file name or, in one source, the relative
    path below its picture folder. ``problem`` is "none", "no item", "several
    items", "empty group" or "conflicting groups" (records of one item differ).
    """
    rel = F.col("relative_path")
    below = F.when(F.col("source_dataset") == "plantvillage", F.array(F.concat(F.lit("raw/color/"), rel), F.concat(F.lit("color/"), rel))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array(F.col("image_path"), rel, X.base_name("image_path")), below))
    known = items.select("item_id", "source_dataset", F.explode(keys).alias("said")).where("said IS NOT NULL")
    records = review.select(X.strip("source_dataset").alias("source_dataset"), X.strip("image_path").alias("said"), X.strip("group_id").alias("group_id"))
    joined = records.join(known, ["source_dataset", "said"], "left").groupBy("source_dataset", "said", "group_id").agg(F.count("item_id").alias("matches"), F.min("item_id").alias("item_id"))
    joined = joined.withColumn("item_id", F.when(F.col("matches") == 1, F.col("item_id")))
    given = joined.where("item_id IS NOT NULL").groupBy("item_id").agg((F.count_distinct("group_id") > 1).alias("differ"))
    problem = (
        F.when(F.col("matches") == 0, "no item").when(F.col("matches") > 1, "several items").when(F.coalesce("group_id", F.lit("")) == "", "empty group").when(F.coalesce("differ", F.lit(False)), "conflicting groups").otherwise("none")
    )
    return joined.join(given, "item_id", "left").withColumn("problem", problem).drop("differ")


def apply_reviewed(items: DataFrame, review: DataFrame) -> DataFrame:
    """Items with the reviewed groups filled in; any problem of the review is an error."""
    matched = match_reviewed(items, review)
    checks.enforce("reviewed groups", matched.where("problem <> 'none'"))
    groups = matched.groupBy("item_id").agg(F.min("group_id").alias("_g"))
    return items.join(groups, "item_id", "left").withColumn("reviewed_group", F.coalesce("_g", "reviewed_group")).drop("_g")


def limit_per_category(rows: DataFrame, category: str, order: str, limit: int, tie: str) -> DataFrame:
    """The first ``limit`` rows of each category in the given order.

    Each task keeps only its own first rows of a category before the shuffle,
    so a large category is never sorted in one place.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    part = rows.withColumn("_p", F.pmod(F.xxhash64(tie), F.lit(64)))
    for keys in (["_p", category], [category]):
        part = part.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).where(F.col("_n") <= limit)
    return part.drop("_p", "_n")


def split_list_inventory(spark: SparkSession, paths: list[str], categories: DataFrame, limit: int | None = None) -> DataFrame:
    """Pictures named by text lists: ``path`` and ``category``, distinct, of known categories in ``raw/color``."""
    lines = spark.read.text(paths).select(X.strip("value").alias("path")).where("path <> ''").distinct()
    parts = F.split("path", "/")
    known = lines.where((F.size(parts) == 4) & F.col("path").startswith("raw/color/")).withColumn("category", F.element_at(parts, 3)).join(categories.select("category"), "category", "left_semi")
    return limit_per_category(known, "category", "path", limit, "path") if limit else known
