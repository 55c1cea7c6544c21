"""Sources that come as ZIP archives: inventory, selection, unpacking and receipts.

An archive is one file, so the driver opens it and unpacks to a folder that the
executors share; what is compared (ids, names, counts) are tables.
"""

from __future__ import annotations

import csv
import hashlib
import io
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from . import tables
from .images import IMAGE_SUFFIXES


def _names(archive: str) -> list[str]:
    with zipfile.ZipFile(archive) as z:
        return [i.filename for i in z.infolist() if not i.is_dir()]


def _digest(path: str) -> str:
    state = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            state.update(block)
    return state.hexdigest()


def csv_tables(archive: str) -> dict[str, list[dict[str, str]]]:
    """Rows of every CSV file in the archive that are not empty; a byte order mark is ignored."""
    out = {}
    with zipfile.ZipFile(archive) as z:
        for name in _names(archive):
            if name.lower().endswith(".csv"):
                rows = csv.DictReader(io.TextIOWrapper(z.open(name), "utf-8-sig", newline=""))
                out[name] = [r for r in rows if any((v or "").strip() for v in r.values() if isinstance(v, str))]
    return out


def _receipt(spark: SparkSession, archive: str, folder: str, files: list[dict], **more) -> dict:
    """What was unpacked, with digests, written beside it."""
    receipt = {"archive": os.path.basename(archive), "bytes": os.path.getsize(archive), "sha256": _digest(archive), **more, "n_files": len(files), "n_bytes": sum(f["bytes"] for f in files), "files": files}
    tables.write_json(spark, f"{folder.rstrip('/')}/receipt.json", receipt)
    return receipt


def unpack_one_hot(spark: SparkSession, archive: str, folder: str, labels: list[str], table: str = "train.csv", prefix: str = "Train_") -> dict:
    """Unpack the label table and the pictures that it names; returns the receipt.

    There must be exactly one ``table``; its rows must be one-hot over
    ``labels``; the ids of its rows and the stems of the pictures with
    ``prefix`` must be the same set. Other pictures stay in the archive.
    """
    found = csv_tables(archive)
    places = [n for n in found if n.rsplit("/", 1)[-1] == table]
    if len(places) != 1:
        raise ValueError(f"expected exactly one {table} in {archive}, found {len(places)}")
    rows = found[places[0]]
    columns = ["image_id", *labels]
    if not rows or set(columns) - set(rows[0]):
        raise ValueError(f"{table} lacks rows or the columns {columns}")
    told = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))
    checks.enforce("one-hot labels", checks.bad_one_hot(told, labels, prefix=prefix))
    pictures = {n: os.path.splitext(n.rsplit("/", 1)[-1])[0] for n in _names(archive) if n.lower().endswith(IMAGE_SUFFIXES)}
    named = {n: s for n, s in pictures.items() if s.startswith(prefix)}
    stems = spark.createDataFrame([(s,) for s in named.values()], "image_id string")
    checks.enforce("one picture per id", checks.not_exactly_one(told, stems, "image_id"))
    checks.enforce("ids and pictures are the same set", checks.set_differences(told, stems, "image_id"))
    files = tables.unpack(archive, folder, lambda n: n in named or n == places[0])
    per_label = {c: sum(float(r[c]) == 1 for r in rows) for c in labels}
    return _receipt(spark, archive, folder, files, tables={n: len(r) for n, r in found.items()}, per_label=per_label, ignored_pictures=len(pictures) - len(named))


def unpack_categories(spark: SparkSession, archive: str, folder: str, categories: DataFrame, per_category: int = 500, depth: int = 3) -> dict:
    """Unpack an archive with one folder per category; returns the receipt.

    Every path must be safe and ``depth`` parts deep, no two names may differ
    in case only, and each category must have exactly ``per_category`` files.
    """
    listed = spark.createDataFrame([(n,) for n in _names(archive)], "path string")
    checks.enforce("inventory of the archive", checks.bad_inventory(listed, categories, per_category, depth))
    files = tables.unpack(archive, folder)
    parts = F.split("path", "/")
    counts = listed.groupBy(F.try_element_at(parts, F.lit(-2)).alias("category")).agg(F.count("*").alias("n")).collect()  # one row per category
    return _receipt(spark, archive, folder, files, per_category={r["category"]: r["n"] for r in sorted(counts)})
