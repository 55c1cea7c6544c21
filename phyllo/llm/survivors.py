"""Best representative of each group of duplicate records.

Dominance compares records by trust (not edited), completeness (pixel area),
provenance (copy marks) and recency (month of the latest reading). A record
dominates another one if it is no worse in all four and better in trust,
completeness or provenance; layer 1 holds the undominated records, layer k
those that only records of earlier layers dominate. Recency so keeps a record
out of the shade of older ones, and cannot shade one that the policy prefers.
The survivor is the best record of layer 1 by a lexicographic policy; each of
its missing fields comes from the first layer that knows it, there again by
the policy.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse_blanks, copy_markers, missing_to_null, spelled

#: Fields of the survivor that successive layers fill.
FILLED = ("make", "model", "capture_time", "software", "width", "height", "sha256_pixels", "capture_id", "camera")

#: Marks of an edited picture in the software field.
EDITORS = "photo editor|photoshop|gimp"


def latest_readings(captures: DataFrame) -> DataFrame:
    """Per item and field the latest non-missing reading; ties by the larger value.

    Blank texts are missing, and so is a capture time that is no date of the
    form YYYY:MM:DD hh:mm:ss. A reading without a time comes before all others.
    """
    texts = [F.nullif(collapse_blanks(c), F.lit("")).alias(c) for c in ("make", "model", "software")]
    time = collapse_blanks("capture_time")
    valid = time.rlike(r"^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$") & (F.substring(time, 1, 4) > "0000")
    time = F.when(valid & F.try_to_timestamp(time, F.lit("yyyy:MM:dd HH:mm:ss")).isNotNull(), time)
    read = captures.where("item_id IS NOT NULL").select("item_id", "read_at", *texts, time.alias("capture_time"), "width", "height")
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("read_at", c))).alias(c) for c in ("make", "model", "software", "capture_time", "width", "height")]
    return read.groupBy("item_id").agg(*latest, F.max("read_at").alias("read_at"))


class Layers:
    """Layers of one group, for vectors that come by falling area, then rising edit and copy marks.

    Of each pair of edit and copy marks only the latest month that reached each
    layer is held, so memory follows the number of layers.
    """

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], list[int]] = {}  # per layer the negated latest month; rising
        self.now, self.waiting = None, []

    def layer(self, edited: int, area: int, markers: int, month: int) -> int:
        # Equal vectors do not dominate each other, so they enter when the next one comes.
        if self.now != (edited, area, markers):
            for (e, _, m), when, depth in self.waiting:
                held = self.cells.setdefault((e, m), [])
                held += [-when] * (depth - len(held))
                for k in range(depth - 1, -1, -1):
                    if held[k] <= -when:
                        break
                    held[k] = -when
            self.now, self.waiting = (edited, area, markers), []
        depth = 1 + max((bisect_right(held, -month) for (e, m), held in self.cells.items() if e <= edited and m <= markers), default=0)
        self.waiting.append((self.now, month, depth))
        return depth


def _layered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``layer`` to vectors that are sorted by ``family_id``, ``class_label`` and as Layers needs them."""
    key, layers = None, Layers()
    for batch in batches:
        out = []
        for family, label, *vector in zip(*(batch.column(c).to_pylist() for c in ("family_id", "class_label", "edited", "area", "markers", "month"))):
            if (family, label) != key:
                key, layers = (family, label), Layers()
            out.append(layers.layer(*vector))
        yield batch.append_column("layer", pa.array(out, pa.int32()))


def survivors(curation: DataFrame, captures: DataFrame) -> DataFrame:
    """The surviving record of each family and class label, its fields filled.

    Records with equal trust, area, markers and month fall together before the
    shuffle (the smallest relative path stands for them, each field from the
    smallest path that knows it), so a task streams only distinct dominance
    vectors of a family, whatever its size. Rows without a family or an item
    are left out; a missing class label is a label of its own; a missing path
    sorts last; an item without a reading is older than all others.
    """
    groups = ["family_id", "class_label"]
    texts = [missing_to_null(c).alias(c) for c in ("sha256_pixels", "capture_id", "camera")]
    records = curation.select(
        spelled("family_id").alias("family_id"), spelled("class_label").alias("class_label"), "item_id", missing_to_null("relative_path").alias("path"), *texts
    ).where("family_id IS NOT NULL AND item_id IS NOT NULL")
    records = records.withColumn("relative_path", F.coalesce("path", F.lit("\U0010ffff"))).withColumn("class_label", F.coalesce("class_label", F.lit("")))
    known = records.join(latest_readings(captures), "item_id", "left")
    ranked = (
        known.withColumn("edited", F.coalesce(F.lower("software").rlike(EDITORS), F.lit(False)).cast("int"))
        .withColumn("area", F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0)))
        .withColumn("markers", F.coalesce(copy_markers("path"), F.lit(0)))
        .withColumn("month", F.coalesce(F.year("read_at") * 12 + F.month("read_at"), F.lit(0)))
    )

    vector = ["edited", "area", "markers", "month"]
    order = F.struct("relative_path", "item_id")
    # Each field keeps the record that knows it, since the policy also orders the records of one layer.
    known_by = [F.min(F.when(F.col(f).isNotNull(), F.struct("relative_path", "item_id", F.col(f).alias("value")))).alias(f) for f in FILLED]
    vectors = ranked.groupBy(*groups, *vector).agg(F.min(order).alias("first"), F.count_distinct("item_id").alias("n"), *known_by)
    vectors = vectors.select(*groups, *vector, "first.relative_path", "first.item_id", "n", *FILLED)
    ordered = vectors.repartition(*groups).sortWithinPartitions(*groups, F.desc("area"), "edited", "markers", F.desc("month"))
    layered = ordered.mapInArrow(_layered, T.StructType([*vectors.schema, T.StructField("layer", T.IntegerType())]))
    policy = ["edited", (-F.col("area")).alias("less"), "markers"]
    best = F.min(F.when(F.col("layer") == 1, F.struct(*policy, "relative_path", "item_id")))
    fills = [F.min(F.when(F.col(f).isNotNull(), F.struct("layer", *policy, f)))[f]["value"].alias(f) for f in FILLED]
    out = layered.groupBy(*groups).agg(best.alias("best"), *fills, F.sum("n").alias("n_records"), F.max("layer").alias("n_layers"))
    return out.select(*groups, "best.item_id", "best.relative_path", *FILLED, "n_records", "n_layers")
