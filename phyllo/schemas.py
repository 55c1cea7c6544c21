"""Explicit schemas of the tables, checked by inclusion and written in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The fields of the published files, in their order.
MANIFEST_FIELDS = (
    "image_path", "source_dataset", "tree_type", "condition", "class_label", "group_id", "split",
    "relative_path", "sha256_pixels", "official_group", "reviewed_group",
)
MANIFEST_REQUIRED = MANIFEST_FIELDS[:7]
PAIR_FIELDS = ("image_path_a", "image_path_b", "source_a", "source_b", "label_a", "label_b", "match_type", "phash_distance")
CURATION_FIELDS = (
    "image_path", "relative_path", "class_label", "sha256_pixels", "capture_id", "capture_time",
    "camera", "family_id", "action", "representative_path", "reason",
)
BAD_FIELDS = ("image_path", "source_dataset", "error")
EXCLUDED_FIELDS = ("image_path", "source_dataset", "class_label", "sha256_pixels", "reason")
PER_CLASS_FIELDS = ("label_index", "class_label", "tree_type", "condition", "support", "precision", "recall", "f1")


def strings(fields: tuple[str, ...]) -> str:
    return ", ".join(f"`{f}` string" for f in fields)


def require(df: DataFrame, fields, what: str) -> DataFrame:
    """``df`` itself if it has all ``fields``; extra columns are allowed."""
    missing = sorted(set(fields) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df
