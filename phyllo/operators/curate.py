"""Choice of one representative per family and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_blanks, copy_markers
from .graph import group_digests
from .relate import order_key

CURATED_SOURCE = "mangoleafbd"

#: Marks of an edited picture in the software field.
EDITORS = "photo editor|photoshop|gimp"


def capture_details(captures: DataFrame) -> DataFrame:
    """What a metadata reading says: capture time (ISO text or ''), key, id, camera, area and edited.

    The key needs make, model and a valid time; year 0000 and impossible dates are invalid.
    """
    make, model, time = (collapse_blanks(c) for c in ("make", "model", "capture_time"))
    shaped = F.col("_time").rlike(r"^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$") & (F.substring("_time", 1, 4) >= "0001")
    iso = F.date_format(F.try_to_timestamp(F.col("_time"), F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss")
    key = F.concat_ws("\n", F.lower("_make"), F.lower("_model"), F.col("capture_time"))
    whole = (F.col("_make") != "") & (F.col("_model") != "") & (F.col("capture_time") != "")
    read = captures.withColumns({"_make": make, "_model": model, "_time": time, "_soft": F.lower(collapse_blanks("software"))})
    return (
        read.withColumn("capture_time", F.coalesce(F.when(shaped, iso), F.lit("")))
        .withColumn("capture_key", F.when(whole, key))
        .withColumn("capture_id", F.coalesce(F.concat(F.lit("capture_"), F.substring(F.sha2("capture_key", 256), 1, 16)), F.lit("")))
        .withColumn("camera", F.concat_ws(" | ", F.nullif("_make", F.lit("")), F.nullif("_model", F.lit(""))))
        .withColumn("area", F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0)))
        .withColumn("edited", F.col("_soft").rlike(EDITORS))
        .drop("_make", "_model", "_time", "_soft")
    )


def latest_captures(captures: DataFrame) -> DataFrame:
    """One reading per item: the latest, and among equal times the greatest in its values."""
    told = ("make", "model", "capture_time", "software", "width", "height")
    best = F.max_by(F.struct(*told), F.struct("read_at", *told))
    return captures.where("item_id IS NOT NULL").groupBy("item_id").agg(best.alias("r")).select("item_id", "r.*")


def capture_edges(items: DataFrame, details: DataFrame) -> DataFrame:
    """Links from the first item of each capture key to the others of the curated source; no key, no link."""
    keyed = items.join(details.where("capture_key IS NOT NULL").select("item_id", "capture_key"), "item_id").select("item_id", "capture_key", order_key().alias("key"))
    firsts = keyed.groupBy("capture_key").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("capture_key", F.col("first.item_id").alias("a"))
    return keyed.join(firsts, "capture_key").where("a <> item_id").select("a", F.col("item_id").alias("b"))


def representatives(members: DataFrame) -> DataFrame:
    """Best row per ``root`` and label: not edited, larger, fewer copy markers, smaller path."""
    rank = F.struct(F.coalesce("edited", F.lit(False)), -F.coalesce("area", F.lit(0)), F.coalesce(copy_markers("relative_path"), F.lit(0)), "relative_path", "image_path")
    return members.groupBy("root", "class_label").agg(F.min_by(F.struct("item_id", "image_path"), rank).alias("best"), F.count("*").alias("members"))


def curate(spark: SparkSession, related: DataFrame, details: DataFrame, source: str = CURATED_SOURCE) -> tuple[DataFrame, DataFrame]:
    """Retained items and the audit of the curated source.

    related: readable items of all sources with ``root``. Family names are made
    from all members before any is left out. Rows of other sources all stay.
    Items of the curated source without a reading count as unedited, of unknown size.
    """
    mine = related.where(F.col("source_dataset") == source).join(details.select("item_id", "capture_id", "capture_time", "camera", "area", "edited"), "item_id", "left")
    best = representatives(mine)
    families = related.join(mine.select("root").distinct(), "root", "left_semi").select("root", F.concat_ws(":", "source_dataset", "relative_path").alias("member"))
    names = group_digests(families, "mango_family_").withColumnRenamed("name", "family_id")
    kept = F.col("item_id") == F.col("best.item_id")
    reason = F.when(F.col("members") == 1, "only photo with its label in the family").when(kept, "chosen by the representative policy").otherwise("related photo with the same label is kept")
    audit = mine.join(best, ["root", "class_label"]).join(names, "root")
    audit = audit.select(
        "item_id", "image_path", "relative_path", "class_label", "sha256_pixels",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("capture_id", "capture_time", "camera")),
        "family_id", F.when(kept, "keep").otherwise("exclude").alias("action"), F.col("best.image_path").alias("representative_path"), reason.alias("reason"),
    )
    dropped = audit.where("action = 'exclude'").select("item_id")
    return related.join(dropped, "item_id", "left_anti"), audit


def curation_by_class(audit: DataFrame) -> DataFrame:
    return audit.groupBy("class_label").agg(
        F.count("*").alias("n_input"), F.count_if(F.col("action") == "keep").alias("n_retained"), F.count_if(F.col("action") == "exclude").alias("n_excluded")
    )


def curation_summary(audit: DataFrame) -> DataFrame:
    """One row: images, retained, capture families, images without capture metadata, families."""
    return audit.agg(
        F.count("*").alias("input_images"),
        F.count_if(F.col("action") == "keep").alias("retained_images"),
        F.count_if(F.col("action") == "exclude").alias("excluded_images"),
        F.count_distinct(F.nullif("capture_id", F.lit(""))).alias("capture_families"),
        F.count_if(F.col("capture_id") == "").alias("images_without_capture_metadata"),
        F.count_distinct("family_id").alias("families"),
    )
