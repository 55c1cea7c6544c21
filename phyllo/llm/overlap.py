"""Same or near-same records across splits.

A suffix array over the records' texts, cut into ranges: each task sorts its
suffixes and compares neighbours. Neighbours that share a prefix of ``min_span``
characters belong to one run, whose first suffix is its centre; the prefix that
a suffix shares with the centre is a span that both records hold. Runs that go
over the border of a task are united by their heads. The spans are merged into
the share of each record that a centre covers, and whole coverage makes a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import spelled, split_word
from ..session import Scratch
from . import neardup
from .linking import components

TRAIN, EVALUATION = 1, 2


def suffixes(records: DataFrame, min_span: int, step: int = 1) -> DataFrame:
    """Suffixes that are long enough for a span: ``id``, ``size``, ``pos`` and ``suffix``.

    A suffix with fewer than ``min_span`` characters cannot start a span and is
    left out. Suffixes start at every ``step``-th character. Of each the first
    2 x ``min_span`` characters are kept: where two texts share more, the later
    suffixes share the next part, so the merged spans have the full extent.
    """
    sized = records.where("text IS NOT NULL").withColumn("size", F.length("text")).where(F.col("size") >= min_span)
    placed = sized.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("size") - min_span, F.lit(step))))
    return placed.select("id", "size", "pos", F.expr(f"substring(text, pos + 1, {2 * min_span})").alias("suffix"))


def _letters(texts: list[str], width: int) -> np.ndarray:
    """One row of code points a text, zeros after its end."""
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)


def common_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows; zeros end a text."""
    differ = (x != y) | (x == 0)
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


TOLD = "a long, b long, pos_a int, pos_b int, size int, span int, whole boolean, text string"


def _runs(min_span: int):
    """Spans that sorted suffixes share with the centre of their run, and the centres of the runs at both borders of the task.

    A suffix that equals the one before it is told with the first such suffix
    (``whole``), any other with the first one of its head. A border row has no
    ``b``; its centre may belong to a run of the task beside it.
    """
    width = 2 * min_span
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pos_a", pa.int32()), ("pos_b", pa.int32()), ("size", pa.int32()), ("span", pa.int32()), ("whole", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = [(0, 0, ""), (0, 0, "")]  # id, pos, suffix of the first suffix of the present head, and of the present suffix
        last, borders, begun = "", set(), False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts = batch.column("suffix").to_pylist()
            ids, pos, size = (batch.column(c).to_numpy() for c in ("id", "pos", "size"))
            rows = _letters([last, *texts], width)
            new = common_prefix(rows[:-1], rows[1:]) < min_span
            other = (rows[:-1] != rows[1:]).any(1)
            if not begun:
                new[0] = other[0] = begun = True
                borders |= {(int(ids[0]), int(pos[0]), texts[0], whole) for whole in (False, True)}
            links = []
            for whole, starts, member in ((False, new, ~new & other), (True, other, ~other)):
                first = np.maximum.accumulate(np.where(starts, np.arange(n), -1))[member] + 1  # 0: the run of the batch before
                old = centres[whole]
                heads = np.concatenate([_letters([old[2]], width), rows[1:]])[first]
                links.append([np.concatenate([[old[0]], ids])[first], ids[member], np.concatenate([[old[1]], pos])[first], pos[member], size[member], common_prefix(heads, rows[1:][member]), np.full(len(first), whole)])
                if starts.any():
                    at = int(np.flatnonzero(starts)[-1])
                    centres[whole] = (int(ids[at]), int(pos[at]), texts[at])
            columns = [pa.array(np.concatenate(c), schema.field(k).type) for k, c in enumerate(zip(*links))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.string())], schema=schema)
            last = texts[-1]
        if begun:
            borders |= {(*centres[whole], whole) for whole in (False, True)}
            yield pa.RecordBatch.from_pylist([{"a": i, "pos_a": p, "text": t, "whole": whole} for i, p, t, whole in sorted(borders)], schema=schema)

    return run


def shared_spans(spark: SparkSession, records: DataFrame, min_span: int, step: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """Spans that records share: ``a``, ``b``, ``pos_a``, ``pos_b``, ``size`` (of b's text) and ``span``.

    records: ``id`` (long) and ``text``; null, empty and short texts hold no
    span. Each suffix is linked to the centre of its run only, so a text that a
    third of all records share gives one span a record and not one a pair. The
    ranges are cut by suffix and id, so its suffixes are spread over several
    tasks; each task tells the centres at its two borders, and these few rows
    give one centre to the parts of a run.
    """
    scratch = scratch or Scratch(spark, "suffixes")
    ordered = suffixes(records, min_span, step).repartitionByRange("suffix", "id", "pos").sortWithinPartitions("suffix", "id", "pos")
    told = scratch.save(ordered.mapInArrow(_runs(min_span), TOLD))
    at = F.struct("text", F.col("a").alias("id"), F.col("pos_a").alias("pos"))
    borders = told.where("b IS NULL").select("whole", F.when(F.col("whole"), F.col("text")).otherwise(F.substring("text", 1, min_span)).alias("run"), at.alias("at"))
    first = borders.groupBy("whole", "run").agg(F.min("at").alias("first"))
    lengths = [F.when(F.substring("at.text", 1, k) == F.substring("first.text", 1, k), F.least(F.lit(k), F.length("at.text"), F.length("first.text"))) for k in range(min_span, 2 * min_span + 1)]
    moved = borders.join(first, ["whole", "run"]).where("at <> first").select(
        "whole", F.col("at.id").alias("a"), F.col("at.pos").alias("pos_a"), F.col("first.id").alias("to_a"), F.col("first.pos").alias("to_pos"), F.greatest(*lengths).alias("most")
    )
    moved = moved.distinct()  # at most four rows a task: what a moved centre told is told of the first one
    spans = told.where("b IS NOT NULL").drop("text").join(moved, ["whole", "a", "pos_a"], "left")
    spans = spans.select(F.coalesce("to_a", "a").alias("a"), "b", F.coalesce("to_pos", "pos_a").alias("pos_a"), "pos_b", "size", F.least("span", "most").alias("span"))
    sizes = records.where("text IS NOT NULL").select(F.col("id").alias("a"), F.length("text").alias("size")).distinct()
    centres = moved.join(sizes, "a").select(F.col("to_a").alias("a"), F.col("a").alias("b"), F.col("to_pos").alias("pos_a"), F.col("pos_a").alias("pos_b"), "size", F.col("most").alias("span"))
    return spans.unionByName(centres)


def coverage(spans: DataFrame, *by: str) -> DataFrame:
    """Share of each record that its spans cover: ``b`` (and the columns ``by``), ``covered``, ``size`` and ``share``.

    By ``a``, what each centre covers by itself; overlapping spans count once.
    """
    keys = [*by, "b"]
    end = F.col("pos_b") + F.col("span")
    before = F.max(end).over(Window.partitionBy(*keys).orderBy("pos_b", "span").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(end - F.greatest(F.col("pos_b"), F.coalesce(before, F.lit(0))), F.lit(0))
    merged = spans.select(*keys, "size", "pos_b", "span").withColumn("new", new)
    return merged.groupBy(*keys).agg(F.sum("new").alias("covered"), F.max("size").alias("size")).withColumn("share", F.col("covered") / F.col("size"))


def sides(manifest: DataFrame) -> DataFrame:
    """In which splits each item stands: ``item_id`` and ``side``; rows without an item or a known split count for nothing."""
    split = split_word("split")
    side = F.when(split == "train", TRAIN).when(split.isin("val", "test"), EVALUATION)
    return manifest.select("item_id", side.alias("side")).where("item_id IS NOT NULL AND side IS NOT NULL").groupBy("item_id").agg(F.bit_or("side").alias("side"))


DIGEST = 64


def pixel_texts(items: DataFrame) -> DataFrame:
    """Text of each readable item: the digest of its pixels, 64 characters in one spelling."""
    said = spelled("sha256_pixels")
    return items.select(F.col("item_id").alias("id"), F.when(said.rlike("^[0-9a-f]{64}$"), said).otherwise(F.sha2(said, 256)).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def same_pixels(spark: SparkSession, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Links ``a``, ``b`` of items of which one's text covers the other's whole: equal pixels.

    Suffixes start at every 16th character of a digest and spans have 32, so a
    digest has three suffixes; two equal ones share the spans at 0, 16 and 32.
    """
    spans = shared_spans(spark, pixel_texts(items), DIGEST // 2, DIGEST // 4, scratch).where("a <> b")
    return coverage(spans, "a").where("covered = size").select("a", "b")


def photographs(spark: SparkSession, items: DataFrame) -> DataFrame:
    """Photograph of each item that shares one: the same pixels by the suffix array, near copies by
    the fragment overlaps of ``neardup``, closed over all items, whatever their split."""
    scratch = Scratch(spark, "overlap")
    edges = scratch.save(same_pixels(spark, items, scratch).unionByName(neardup.near_pairs(spark, items)))
    return components(spark, edges, scratch).select(F.col("node").alias("item_id"), F.col("root").alias("group_item_id"))


def split_overlaps(spark: SparkSession, items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pairs of records of one photograph across splits: ``item_id_a`` < ``item_id_b``.

    One of the pair stands in train and the other in validation or test; an
    item may stand in both. Items of one split only link the others.
    """
    known = photographs(spark, items).join(sides(manifest), "item_id")
    trained = known.where(F.col("side").bitwiseAND(TRAIN) > 0).select("group_item_id", F.col("item_id").alias("t"), (F.col("side") == TRAIN + EVALUATION).alias("t_both"))
    others = known.where(F.col("side").bitwiseAND(EVALUATION) > 0).select("group_item_id", F.col("item_id").alias("e"), (F.col("side") == TRAIN + EVALUATION).alias("e_both"))
    # Where both stand on both sides the pair would come twice.
    pairs = trained.join(others, "group_item_id").where("t < e OR t > e AND NOT (t_both AND e_both)")
    return pairs.select(F.least("t", "e").alias("item_id_a"), F.greatest("t", "e").alias("item_id_b"))


def overlap_report(photos: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per evaluation split and source: items of the split whose photograph stands in train, those of them
    that stand in train by their own rows, and pairs that link the split to train.

    An item whose own rows name both splits makes no pair; it counts with or
    without a copy. Pairs are counted from the numbers of training items per
    photograph and never built.
    """
    rows = manifest.select("item_id", split_word("split").alias("split"), spelled("source_dataset").alias("source_dataset")).where("item_id IS NOT NULL AND split IS NOT NULL").distinct()
    trained = rows.where("split = 'train'").select("item_id", F.lit(1).alias("own")).distinct()
    per_photo = photos.join(trained, "item_id").groupBy("group_item_id").agg(F.count("*").alias("n_train"))
    reach = photos.join(per_photo, "group_item_id").select("item_id", "n_train")
    found = rows.where("split <> 'train'").join(trained, "item_id", "left").join(reach, "item_id", "left")
    others = F.coalesce("n_train", F.lit(0)) - F.when(F.col("n_train").isNotNull(), F.coalesce("own", F.lit(0))).otherwise(0)
    found = found.withColumn("others", others).where("own = 1 OR others > 0")
    return found.groupBy("split", "source_dataset").agg(F.count("*").alias("n_items"), F.count("own").alias("n_own"), F.sum("others").alias("n_pairs"))
