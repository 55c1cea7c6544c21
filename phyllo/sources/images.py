"""Image folders: listing, decoding and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.images import EXIF_SCHEMA, exif_frame, fingerprint_batches

#: Suffixes of pictures, in lower case.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")


def is_image_path(path: Column | str) -> Column:
    """Whether a relative path names a picture and no part of it begins with a dot; null paths do not."""
    path = X.col(path)
    hidden = F.exists(F.split(path, "/"), lambda p: p.startswith("."))
    return F.coalesce(F.lower(X.suffix(path)).isin(*IMAGE_SUFFIXES) & ~hidden, F.lit(False))


def find_images(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """Pictures below a folder: ``image_path``, ``relative_path``, ``length`` (and ``content``).

    Spark's scan leaves out files without content and names that begin with an
    underscore. The contents are read only if asked for, since the scan prunes that column.
    """
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    plain = root.removeprefix("file://")
    rows = files.withColumn("image_path", path).withColumn("relative_path", F.expr(f"substring(image_path, {len(plain) + 2})"))
    rows = rows.where(is_image_path("relative_path"))
    return rows.select("image_path", "relative_path", "length", *(["content"] if with_content else []))


def fingerprints(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixel hash and eight perceptual hashes of each picture, and the unreadable ones.

    images: ``image_path`` and ``content``; the files are decoded in Arrow batches.
    Returns (``image_path``, ``sha256_pixels``, ``hashes``, ``width``, ``height``)
    and (``image_path``, ``error``).
    """
    done = images.select("image_path", "content").mapInArrow(fingerprint_batches, "image_path string, sha256_pixels string, hashes array<long>, width int, height int, error string")
    return done.where("error IS NULL").drop("error"), done.where("error IS NOT NULL").select("image_path", "error")


def capture_metadata(images: DataFrame) -> DataFrame:
    """EXIF fields of each JPEG: make, model, capture_time, software, width and height as raw values, and ``error`` where they are broken."""
    fields = F.pandas_udf(exif_frame, EXIF_SCHEMA)("content")
    return images.select("image_path", fields.alias("e")).select("image_path", "e.*")


def file_receipts(files: DataFrame) -> DataFrame:
    """SHA-256 and size of each file: ``relative_path``, ``bytes``, ``sha256``."""
    return files.select("relative_path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
