"""Typed tables: manifests, label tables, training runs; and writers that publish only checked results."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import checks


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV file with header as strings; empty fields are empty strings, a byte order mark is ignored."""
    df = spark.read.csv(path, header=True, nullValue="\x00", emptyValue="", multiLine=True, escape='"')
    return schemas.require(df.na.fill(""), required, path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label list (JSON): ``label_index``, ``class_label``, ``tree_type``, ``condition``, checked."""
    raw = spark.read.schema("index int, label string, tree_type string, condition string").json(path, multiLine=True)
    labels = raw.select(F.col("index").alias("label_index"), F.col("label").alias("class_label"), "tree_type", "condition")
    checks.enforce("label table", checks.bad_label_table(labels))
    if not labels.limit(1).count():
        raise ValueError(f"{path} has no labels")
    return labels


def read_manifest(spark: SparkSession, path: str, labels: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A manifest with the index of each row's label as ``target``; every constraint is checked.

    A relative ``image_path`` is meant below the folder that holds the manifest.
    files: known ``image_path`` values, if the existence of files is to be checked.
    """
    rows = read_csv(spark, path, schemas.MANIFEST_REQUIRED)
    folder = path.rstrip("/").rsplit("/", 1)[0] if "/" in path.rstrip("/") else "."
    whole = F.col("image_path").rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*://)") | (F.col("image_path") == "")
    rows = rows.withColumn("image_path", F.when(whole, F.col("image_path")).otherwise(F.concat(F.lit(folder + "/"), F.col("image_path"))))
    broken = checks.manifest_violations(rows, labels, spark, files).where("violations > 0 AND constraint NOT IN ('splits_filled', 'labels_in_train')")
    checks.enforce("manifest", broken)
    if not rows.limit(1).count():
        raise ValueError("the manifest is empty")
    return rows.join(labels.select("class_label", F.col("label_index").alias("target")), "class_label")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(target) and (not fs.getFileStatus(target).isDirectory() or len(fs.listStatus(target)) > 0)


def guard_output(spark: SparkSession, path: str) -> None:
    """An output folder must be new or empty."""
    if _exists(spark, path):
        raise FileExistsError(f"{path} is not empty")


def write_csv(df: DataFrame, path: str, fields: tuple[str, ...], order: tuple[str, ...] = (), single: bool = False) -> None:
    """CSV parts with a header each, also for an empty table; only ``fields``, in their order.

    With ``order`` the parts are ranges of the sorted table, so their names give
    its order. ``single`` makes one part of a dimension or another small table.
    """
    out = schemas.require(df, fields, path)
    out = out.orderBy(*order) if order else out
    out = out.select(*fields)
    (out.coalesce(1) if single else out).write.mode("errorifexists").csv(path, header=True, emptyValue="", quoteAll=False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed, so that no reader sees half of it.

    The same content again is fine; other content at the place is an error.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    data = text.encode("utf-8")
    if fs.exists(target):
        stream = fs.open(target)
        try:
            old = bytes(b & 0xFF for b in stream.readAllBytes())
        finally:
            stream.close()
        if old != data:
            raise FileExistsError(f"{path} has other content")
        return
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = fs.create(part, True)
    stream.write(bytearray(data))
    stream.close()
    if not fs.rename(part, target):
        raise OSError(f"could not rename to {path}")


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def label_json(labels: DataFrame) -> list[dict]:
    rows = labels.orderBy("label_index").collect()  # a dimension
    return [{"index": r["label_index"], "label": r["class_label"], "tree_type": r["tree_type"], "condition": r["condition"]} for r in rows]


def safe_member(name: str) -> bool:
    """Whether a name in an archive stays inside the folder it is unpacked to."""
    return bool(name) and not name.startswith(("/", "\\")) and "\\" not in name and ".." not in name.split("/") and not re.match(r"^[A-Za-z]:", name)


def unpack(archive: str, folder: str, wanted=lambda name: True) -> list[dict]:
    """Unpack the wanted members of a ZIP archive and return their receipts (path, bytes, sha256).

    Nothing is replaced: a file of other content at a member's place is an error.
    """
    import hashlib
    import os
    import zipfile

    receipts = []
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            if info.is_dir() or not wanted(info.filename):
                continue
            if not safe_member(info.filename):
                raise ValueError(f"unsafe name in the archive: {info.filename!r}")
            data = z.read(info)
            place = os.path.join(folder, *info.filename.split("/"))
            os.makedirs(os.path.dirname(place), exist_ok=True)
            if os.path.exists(place):
                with open(place, "rb") as f:
                    if f.read() != data:
                        raise FileExistsError(f"{place} has other content")
            else:
                with open(place + ".part", "wb") as f:
                    f.write(data)
                os.rename(place + ".part", place)
            receipts.append({"path": info.filename, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    return receipts
