"""The label dimension and the published spellings of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_name

#: Conditions of each kind of tree.
TREE_CONDITIONS = {
    "apple": ["healthy", "scab", "black_rot", "cedar_apple_rust", "multiple_diseases"],
    "cherry": ["healthy", "powdery_mildew"],
    "peach": ["healthy", "bacterial_spot"],
    "orange": ["citrus_greening"],
    "mango": ["healthy", "anthracnose", "bacterial_canker", "cutting_weevil", "dieback", "gall_midge", "powdery_mildew", "sooty_mould"],
}

#: Folder and column names as the sources publish them.
SOURCE_LABELS = {
    "plantvillage": {
        "Apple___Apple_scab": "apple_scab",
        "Apple___Black_rot": "apple_black_rot",
        "Apple___Cedar_apple_rust": "apple_cedar_apple_rust",
        "Apple___healthy": "apple_healthy",
        "Cherry_(including_sour)___Powdery_mildew": "cherry_powdery_mildew",
        "Cherry_(including_sour)___healthy": "cherry_healthy",
        "Peach___Bacterial_spot": "peach_bacterial_spot",
        "Peach___healthy": "peach_healthy",
        "Orange___Haunglongbing_(Citrus_greening)": "orange_citrus_greening",
    },
    "cornell": {
        "healthy": "apple_healthy",
        "scab": "apple_scab",
        "rust": "apple_cedar_apple_rust",
        "multiple_diseases": "apple_multiple_diseases",
    },
    "mangoleafbd": {
        "Anthracnose": "mango_anthracnose",
        "Bacterial Canker": "mango_bacterial_canker",
        "Cutting Weevil": "mango_cutting_weevil",
        "Die Back": "mango_dieback",
        "Gall Midge": "mango_gall_midge",
        "Healthy": "mango_healthy",
        "Powdery Mildew": "mango_powdery_mildew",
        "Sooty Mould": "mango_sooty_mould",
    },
}


def label_rows(tree_conditions: dict[str, list[str]] = TREE_CONDITIONS) -> list[tuple[int, str, str, str]]:
    """(index, label, tree_type, condition), numbered in the order of the labels."""
    names = sorted((f"{tree}_{c}", tree, c) for tree, cs in tree_conditions.items() for c in cs)
    return [(i, *row) for i, row in enumerate(names)]


def labels(spark: SparkSession, tree_conditions: dict[str, list[str]] = TREE_CONDITIONS) -> DataFrame:
    return spark.createDataFrame(label_rows(tree_conditions), "label_index int, class_label string, tree_type string, condition string")


def label_map(spark: SparkSession, sources: dict[str, dict[str, str]] = SOURCE_LABELS) -> DataFrame:
    rows = [(s, k, v) for s, names in sources.items() for k, v in names.items()]
    return spark.createDataFrame(rows, "source_dataset string, source_label string, class_label string")


def reindex(dimension: DataFrame, observed: DataFrame) -> DataFrame:
    """The labels that occur in ``observed``, numbered again from 0 in their old order.

    The dimension has one row per label of the project, so one task numbers it.
    """
    from pyspark.sql.window import Window

    kept = dimension.join(observed.select("class_label").distinct(), "class_label", "left_semi")
    number = (F.row_number().over(Window.orderBy("label_index")) - 1).cast("int")
    return kept.select(number.alias("label_index"), "class_label", "tree_type", "condition")


def with_label(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Tree type, condition and index of each row's label; rows with an unknown label are left out.

    See ``checks.unknown_labels`` for those.
    """
    dim = dimension.select("class_label", "label_index", "tree_type", "condition")
    return rows.drop("label_index", "tree_type", "condition").join(dim, "class_label")


def from_folder(rows: DataFrame, mapping: DataFrame, source: str, folder: str = "folder") -> DataFrame:
    """Class label of each row from its folder name, ignoring case, blanks and punctuation."""
    names = mapping.where(F.col("source_dataset") == source).select(normalize_name("source_label").alias("_key"), "class_label")
    return rows.withColumn("_key", normalize_name(folder)).join(names, "_key", "left").drop("_key")
